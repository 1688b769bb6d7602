import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import byte_bpe, exact_dedup, langid, maxent, packing, quality, sharding
from quire.llm.common import SPACES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, record string, row long, digest string, id string"
WORDS = "the of and to in is was with for on thing tion house garden green 42 x9 don't".split()


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, src, 0, "r", 7, "d", "i") for k, t, lang, src in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    out = [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randrange(1, 80))), "en", f"s{i % 4}") for i in range(80)]
    out += [(100 + i, "Same TEXT in many copies, é É", "fr", "s0") for i in range(40)] + [(150, "same text in many copies, é É", None, "s1"), (151, "same text in many copies, é é", None, None)]
    out += [(None, None, None, None), (None, None, None, None), (200, "", "de", "s2"), (201, None, "de", "s2"), (202, " \n\t ", "de", None), (203, "a " * 60_000, "en", "s3"), (204, out[0][1], "en", "s0"), (204, out[0][1], "en", "s0"), (205, "漢字 😀 <|endoftext|>", "zz", "s3")]
    return out


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(spark, rows):
    out = exact_dedup.mark_duplicates(table(spark, rows), support=0.05).collect()
    groups = collections.defaultdict(list)
    for k, t, *_ in rows:
        groups[hashlib.sha256(fold(t).encode()).digest()].append(k)
    assert len(out) == len(rows)
    for r in out:
        own = groups[bytes(r.digest)]
        best = max((k for k in own if k is not None), default=None)
        assert r.group_size == len(own) and r.keep_id == best and (not r.kept or r.id == best)
    assert sum(r.kept for r in out) == len(groups)
    for support in (0.001, 0.05, 0.5):
        left = exact_dedup.drop_duplicates(table(spark, rows), support=support).collect()
        assert len(left) == len(groups) and left[0].record == "r"
        want = {d: max((k for k in ks if k is not None), default=None) for d, ks in groups.items()}
        assert {hashlib.sha256(fold(r.text).encode()).digest(): r.doc_id for r in left} == want


def test_sharding(spark, rows):
    docs = table(spark, rows)
    out = sharding.shard_records(docs, F.struct("doc_id", sharding.text_crc32(F.col("text"))), sharding.text_size(F.col("text")), shards=5, least_buckets=7).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert collections.Counter((r.record.doc_id, r.record.text) for r in out) == collections.Counter((k, t) for k, t, *_ in rows)
    again = sharding.shuffle_records(docs, F.struct("doc_id", sharding.text_crc32(F.col("text"))), sharding.text_size(F.col("text")), least_buckets=7)
    assert [r.position for r in again.orderBy("position").collect()] == list(range(len(rows)))


def test_sharding_is_written_in_order_and_repeatable(spark, rows, tmp_path):
    key, size = F.struct("doc_id", sharding.text_crc32(F.col("text"))), sharding.text_size(F.col("text"))
    docs = table(spark, rows)
    out = sharding.shard_records(docs, key, size, shards=4, least_buckets=6)
    sharding.write_shards(out, f"{tmp_path}/shards")
    placed = {(r.shard, r.slot): (r.record.doc_id, r.record.text) for r in out.collect()}
    for shard in range(4):
        back = spark.read.parquet(f"{tmp_path}/shards/shard={shard}").collect()
        assert [(r.doc_id, r.text) for r in sorted(back, key=lambda r: r.slot)] == [placed[shard, i] for i in range(len(back))]
    again = {(r.shard, r.slot): (r.record.doc_id, r.record.text) for r in sharding.shard_records(table(spark, rows[::-1]).repartition(3), key, size, shards=4, least_buckets=6).collect()}
    assert again == placed
    assert [placed[0, i] for i in range(5)] != [(k, t) for k, t, *_ in rows[:5]]


def test_many_equal_rows_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 100)
    rows = [(1, "same")] * 1200 + [(1, "SAME")] * 3 + [(i, f"t{i}") for i in range(200)] + [(None, None)] * 300
    key, size = F.struct("doc_id", F.lower("text")), sharding.text_size(F.col("text"))
    deal = lambda n: sharding.shuffle_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), key, size, least_buckets=8).collect()
    out = deal(3)
    assert sorted(r.position for r in out) == list(range(len(rows))) and collections.Counter((r.record.doc_id, r.record.text) for r in out) == collections.Counter(rows)
    assert max(collections.Counter(r.bucket for r in out).values()) < 400
    assert {r.position: (r.record.doc_id, r.record.text) for r in deal(5)} == {r.position: (r.record.doc_id, r.record.text) for r in out}


def brute_quality(text):
    t = text or ""
    w = [x for x in "".join(" " if c in SPACES else c for c in t).split(" ") if x]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(SPACES)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, rows):
    more = rows + [(300, "a b c d e f a b c d e g a b c d e", "en", "s0"), (301, "x\ny\nx\n \nx", "en", "s0"), (302, "a#b*c|", "en", "s0")]
    out = quality.judge(table(spark, more)).collect()
    assert len(out) == len(more)
    kept = quality.keep_good(table(spark, more))
    assert kept.columns == table(spark, more).columns and collections.Counter((r.doc_id, brute_quality(r.text)[0]) for r in kept.collect()) == collections.Counter((r.id, r.n_words) for r in out if r.kept)
    want = collections.Counter((k, *brute_quality(t)) for k, t, *_ in more)
    assert collections.Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want


def test_bad_hosts_lose_all(spark, monkeypatch):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good, "en", f"h{i % 5}") for i in range(100)] + [(200 + i, bad if i < 19 else good, "en", "spam") for i in range(20)] + [(300, good, "en", None), (301, bad, "en", None)]
    for most in (100, 0):  # by broadcast, and by salted keys
        monkeypatch.setattr(quality.join_hosts, "__defaults__", ("host", most))
        out = {r.id: r.kept for r in quality.judge(table(spark, rows)).collect()}
        assert all(out[i] for i in range(100)) and not any(out[200 + i] for i in range(20)) and out[300] and not out[301]


def test_packing(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    out = packing.pack(table(spark, rows), path, window=64, most_open=3).collect()
    pieces, sequences = collections.defaultdict(collections.Counter), collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id][(r.start, bytes(r.ids))] += 1
        sequences[r.sequence_id].append((r.offset, len(r.ids) // 4))
    want = collections.defaultdict(collections.Counter)
    for k, t, *_ in rows:
        ids = np.asarray([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 64):
            want[k][(a, ids[a : a + 64].tobytes())] += 1
    assert pieces == want
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64


def test_windows_best_fit_and_fullest_out():
    windows = packing.Windows(2, 10)
    assert windows.put(6, "a") == [] and windows.put(7, "b") == []
    assert windows.put(3, "c") == [["b", "c"]]  # the tightest room that fits, and a full window is done
    assert windows.put(5, "d") == []
    assert windows.put(8, "e") == [["a"]]  # fits nowhere: the fullest goes
    assert windows.put(2, "f") == [["e", "f"]] and windows.rest() == [["d"]]


def test_packing_leaves_little_padding(spark):
    public = pytest.importorskip("public_tokenizers")
    draw = random.Random(2)
    texts = [(i, " ".join(draw.choice(WORDS) for _ in range(int(draw.expovariate(0.02)) + 1))) for i in range(600)]
    out = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), public.path("word_bpe_49k.json"), window=256, most_open=16).collect()
    tokens = sum(len(r.ids) // 4 for r in out)
    assert tokens / (256 * len({r.sequence_id for r in out})) > 0.95


def test_long_text_is_coded_as_a_whole(spark):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    text = ("the house and garden 42 é 漢字\n" * 60_000) + "x" * 5000
    assert len(text) > byte_bpe.LISTED
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    out = {r.id: r for r in byte_bpe.decode_ids(byte_bpe.encode_texts(docs, path, public.PATTERN), path).collect()}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.load(path).ranks, special_tokens={})
    assert bytes(out[1].decoded) == text.encode() and np.frombuffer(out[1].ids, "<u4").tolist() == library.encode_ordinary(text) and bytes(out[2].ids) == b""
    assert byte_bpe.encode_texts(docs.where("doc_id = 9"), path, public.PATTERN).count() == 0


def test_packing_tokens_of_odd_words():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    coder, memo, draw = Tokenizer.from_file(path), packing.word_ids(path), random.Random(5)
    marks = [f"{x}{f(m)}{y}" for m in ("<|startoftext|>", "<|endoftext|>") for f in (str.lower, str.upper, str.title) for x in ("", "a", "a ", ".") for y in ("", "b", " b", ".", "<|endoftext|>")]
    texts = [*marks, "<|EndOfText|>", *marks] + ["".join(draw.choice(a) for _ in range(draw.choice([0, 1, 7, 60]))) for a in ("abé ñß.,!?;:'", "aÁ ëﬁÀ\n\t.", "漢か x1٣², '", "Σσς ΑΣ. İıſª", "\x1c\x85 ab.,", "'s't re'll") for _ in range(200)]
    ids, bounds = packing.token_arrays(pa.array(texts), memo)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*coder.encode(t, add_special_tokens=False).ids, 1], t


def test_byte_bpe(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.load(path)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    encode, draw = byte_bpe.encoder(path, public.PATTERN), random.Random(3)
    for alphabet in ("ab", "a", "abc ", "the in", "aAbB1 \n\t!", "\x1c\x1f 　a ", "éñ😀漢 x"):
        for size in (1, 5, 30, 100, 700):
            for _ in range(20):
                t = "".join(draw.choice(alphabet) for _ in range(size))
                ids = np.frombuffer(encode(t), "<u4").tolist()
                assert ids == library.encode_ordinary(t) and bpe.decode(ids) == t.encode()
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(table(spark, rows), path, public.PATTERN), path).collect()
    assert collections.Counter((r.id, bytes(r.decoded)) for r in out) == collections.Counter((k, (t or "").encode()) for k, t, *_ in rows)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(bytes(r.decoded).decode()) for r in out)


def test_language(spark, rows):
    draw = random.Random(9)
    stock = {"en": "the of and thing with house", "de": "der die und haus mit für", "fr": "le la et maison avec été"}
    docs = [(i, " ".join(draw.choice(stock[k].split()) for _ in range(12)), k, "s") for i in range(150) for k in [list(stock)[i % 3]]]
    frame = table(spark, docs + rows)
    models = langid.fit(frame, counted=40, calibrated=10)
    out = langid.identify(frame, models).collect()
    assert len(out) == len(docs) + len(rows)
    truth = {k: lang for k, _, lang, _ in docs}
    judged = [r for r in out if r.id in truth and zlib.crc32(str(r.id).encode()) % 5 == 0 and r.id < 80]
    none = [r for r in out if r.id in (200, 201, 202) or r.id is None]
    assert len(none) == 5 and all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in none)
    assert judged and all(0 <= r.score <= 1 for r in out)
    kept = langid.keep_identified(frame, models)
    assert kept.columns == frame.columns and kept.count() == sum(not r.rejected for r in out)
    alone = langid.identify(table(spark, docs), langid.fit(table(spark, docs))).collect()
    assert sum(r.lang_pred == truth[r.id] for r in alone) >= 0.98 * len(alone)


def brute_kneser_ney(counts, order=langid.ORDER):
    """P(character | what stands before it in the word), by the textbook's recursion over dictionaries."""
    tables = []
    for n in range(1, order + 1):
        own, kinds = collections.Counter(), collections.defaultdict(set)
        for w, times in counts:
            m = langid.START + w + langid.STOP
            for i in range(max(1, n - 1), len(m)):
                gram = m[i - n + 1 : i + 1]
                own[gram] += times
                if i >= n:
                    kinds[gram].add(m[i - n])
        value = {g: c if n == order or g[0] == langid.START else max(len(kinds[g]), 1e-9) for g, c in own.items()}
        ones, twos = sum(v == 1 for v in value.values()), sum(v == 2 for v in value.values())
        tables.append((value, min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))))

    def p(history, c, n):
        if not n:
            return 1 / (len({x for w, _ in counts for x in w}) + 2)
        value, d = tables[n - 1]
        context = history[len(history) - n + 1 :] if n > 1 else ""
        after = {g: v for g, v in value.items() if g[:-1] == context}
        lower = p(history, c, n - 1)
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get(context + c, 0) - d, 0) / total + sum(min(v, d) for v in after.values()) / total * lower

    return p


@pytest.mark.parametrize("dense", [16, 0])
def test_models_against_brute_force(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    draw = random.Random(4)
    counts = [("".join(draw.choice("abcde") for _ in range(draw.randrange(1, 9))), draw.randrange(1, 6)) for _ in range(60)]
    counts = list({w: n for w, n in counts}.items())
    models = langid.CharModels(["x", "y"], {"x": counts, "y": [("zzz", 1)]})
    p = brute_kneser_ney(counts)
    # the models of several languages share one alphabet for the unseen
    models.floor = 1 / (len({x for w, _ in counts for x in w}) + 2)
    for w in [w for w, _ in counts[:20]] + ["abcabc", "eeeeeeee", "q", "aqb"]:
        m = langid.START + w + langid.STOP
        want = sum(math.log(p(m[:i], m[i], min(langid.ORDER, i + 1))) for i in range(1, len(m)))
        assert models.score_words([w])[0, 0] == pytest.approx(want, rel=1e-4)
    for history in ("\x02", "\x02a", "\x02ab", "\x02zz"):
        assert sum(p(history, c, min(langid.ORDER, len(history) + 1)) for c in "abcde\x03") <= 1 + 1e-9


def test_language_rejects_noise_and_keeps_labels(spark):
    draw = random.Random(9)
    stock = {"en": "the of and thing with house over under people water", "de": "der die und haus mit für wasser über leute straße", "fr": "le la et maison avec été eau gens sous rue"}
    docs = [(i, " ".join(draw.choice(stock[k].split()) for _ in range(draw.choice([3, 12, 60]))), k, "s") for i in range(300) for k in [list(stock)[i % 3]]]
    docs += [(1000 + i, " ".join(draw.choice("vesi talo kanssa ihmiset katu joki".split()) for _ in range(9000)), "fi", "s") for i in range(20)]  # long ones only
    odd = [(2000, "zxq vkj qqwz jkxv zzkq xqj " * 20, None, "s"), (2001, "漢字 漢字漢 字漢字 " * 10, None, "s"), (2002, "".join(draw.choice("абвгдежз ") for _ in range(300)), None, "s")]
    frame = table(spark, docs + odd)
    models = langid.fit(frame, counted=60, calibrated=20)
    out = {r.id: r for r in langid.identify(frame, models).collect()}
    assert models.languages == ["de", "en", "fi", "fr"] and all(out[k].lang_pred == "fi" for k in range(1000, 1020))
    assert all(out[k].rejected for k, *_ in odd) and not any(out[k].rejected for k, *_ in docs)


def test_maxent_base_and_order(spark, rows):
    out = maxent.score_texts(table(spark, rows)).collect()
    tokens = [(k, [x for x in "".join(" " if c in SPACES else c for c in fold(t)).split(" ") if x] + [None]) for k, t, *_ in rows]
    held = lambda k: zlib.crc32(str(k if k is not None else "").encode()) % 7 == 2
    c = collections.Counter(w for k, x in tokens for w in x if not held(k))
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), held(k), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for k, x in tokens)
    assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_maxent_trains_on_every_position(spark):
    # every word stands in one document only: a position that is left out leaves the weights of the word before it at zero
    texts = [f"a{i} b{i} c{i}" for i in range(300)]
    rows = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "key long, text string, held boolean").withColumn("id", F.col("key")).repartition(4)
    model = maxent.fit(rows)
    assert (model.tokens, model.kinds) == (1200, 901)
    hashes, codes, bounds = maxent.token_codes(pa.array(texts))
    one, _, _ = model.features(model.places(hashes)[codes], bounds)
    assert len(set(one)) == 901 and (model.weights[one] != 0).any(1).all()


def test_maxent_against_a_plain_loop(spark, monkeypatch):
    for name, value in (("TOP", 12), ("MEMBERS", 4), ("CLASSES", 3), ("COUNTED", 20)):
        monkeypatch.setattr(maxent, name, value)
    draw = random.Random(8)
    stock = [f"w{i}" for i in range(60)]
    texts = [" ".join(stock[min(int(draw.expovariate(0.1)), 59)] for _ in range(draw.randrange(0, 30))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.id: r for r in maxent.score_texts(docs).collect()}
    text = F.col("text")
    rows = docs.select(F.xxhash64("doc_id", text).alias("key"), "text", maxent.held_out(F.col("doc_id")).alias("held"), F.col("doc_id").alias("id"))
    model = maxent.fit(rows)
    assert len(model.words) == 12 and (model.inside != 0).any() and (model.weights != 0).any()
    counts = collections.Counter(w for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2 for w in [*t.split(), None])
    hash_of = lambda w: np.uint64(maxent.END) if w is None else maxent.token_codes(pa.array([w]))[0][0]
    place = lambda w: int(model.places(np.asarray([hash_of(w)], np.uint64))[0])
    listed = {int(h) for h in model.listed}
    is_listed = lambda w: int(hash_of(w)) in listed
    group = lambda w: int(maxent.group_of(np.asarray([hash_of(w)]))[0])
    rare = [w for w in counts if place(w) == len(model.words)]
    assert any(map(is_listed, rare)) and not all(map(is_listed, rare))
    mass = collections.Counter()
    for w in rare:
        mass[group(w) if is_listed(w) else "other"] += counts[w] - maxent.DISCOUNT
    unknown = maxent.DISCOUNT * len(rare)
    mass["other"] += unknown
    share_of_other = mass["other"] / sum(mass.values())

    def softmax(x):
        return np.exp(x - np.log(np.exp(np.asarray(x, np.float64)).sum()))

    def p(word, one, two):
        n = len(model.words) + 2
        at = [n - 1 if w == "start" else place(w) for w in (one, two)]
        both = (at[0] * 7919 + at[1] * 104729 + 13) * 2654435761 % 2**32 % maxent.HASHED
        classes = softmax(model.bias + model.weights[at[0]] + model.weights[n + at[1]] + model.weights[2 * n + both])
        kind = int(model.classes[place(word)])
        words = np.asarray([np.uint64(0) if w == "start" else hash_of(w) for w in (two, one, word)], np.uint64)
        mine = [c[-1:] for c in maxent._contexts(words, np.asarray([0, 3]))] if two != "start" else None
        if mine is None:
            start = [x for x in (one, word) if x != "start"]
            mine = [c[-1:] for c in maxent._contexts(np.asarray([hash_of(x) for x in start], np.uint64), np.asarray([0, len(start)]))]
        slots = model.members[kind]
        inner = softmax(model.slot_bias[slots] + sum(model.inside[model.cells_of(c, slots)][0] for c in mine))
        if place(word) < len(model.words):
            return classes[kind] * inner[list(slots).index(place(word))]
        if not is_listed(word):
            return classes[kind] * share_of_other * (counts[word] - maxent.DISCOUNT if counts[word] else unknown) / mass["other"]
        return classes[kind] * (1 - share_of_other) * inner[list(slots).index(len(model.words) + group(word))] * (counts[word] - maxent.DISCOUNT) / mass[group(word)]

    for k, t in enumerate(texts[:25]):
        tokens = t.split()
        before = ["start", "start", *tokens]
        want = sum(math.log10(p(w, before[i + 1], before[i])) for i, w in enumerate([*tokens, None]))
        assert out[k].score == pytest.approx(want, rel=1e-3)
    # known words, the end and the unknown word add up to one
    for one, two in (("start", "start"), ("w3", "w1"), ("w59", "nowhere")):
        assert sum(p(w, one, two) for w in [*counts, "unheard"]) == pytest.approx(1, abs=1e-3)


def test_gathered_and_most_counted(spark):
    from quire.llm import common

    batches = [pa.RecordBatch.from_pydict({"id": [i], "text": ["x" * n]}) for i, n in enumerate([3, 4, 2, 9, 1, 0])]
    assert [b.column(0).to_pylist() for b in common.gathered(batches, 9)] == [[0, 1, 2], [3], [4, 5]]
    assert list(common.gathered([], 9)) == [] and [list(x) for x in common.row_slices([3, 4, 2, 9, 1], 9)] == [[0, 3], [3, 4], [4, 5]]
    counts = common.shared_table(spark.createDataFrame([(i, 2**i) for i in range(12)], "word long, n long"), "counts")
    assert sorted(r.word for r in common.most_counted(counts, 5).collect()) == [7, 8, 9, 10, 11] and common.most_counted(counts, 99).count() == 12
    common.discard(counts)
    common.discard(spark.range(1))


def test_empty_tables(spark):
    docs = table(spark, [(1, "x", "en", "s")]).where("doc_id = 2")
    assert exact_dedup.mark_duplicates(docs).count() == 0
    assert sharding.shard_records(docs, F.col("doc_id"), sharding.text_size(F.col("text"))).count() == 0
    assert quality.judge(docs).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == 0
    assert maxent.score_texts(docs).count() == 0
