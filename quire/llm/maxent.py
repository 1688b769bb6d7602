"""Scoring of texts by a hashed maximum-entropy language model.

P(word | context) = P(class | context) * P(member | class, context), both
softmaxes. Classes are bins of the most frequent words, the end token, and
one class of all rarer words. The class features are the word before, the
word two before (a skip) and a hash of both; those inside a class are hashes
of the member with the word before and with the word two before, whatever
words these are. Members of the rare class are hashed groups of the words
whose counts are broadcast; in its group a word has its discounted share of
the exact counts. A fixed share of the class is left to all other words by
their discounted counts, and to the unknown word, which has what was
discounted.

Counts are exact and cover every training document. The most counted words
are broadcast with their counts; of all others, postings meet by word, so
that no word's postings grow beyond the least count of the broadcast ones.
Weights are trained by rounds of gradient updates in all partitions, whose
changes are averaged; tables of hashed weights grow with the vocabulary up to
a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import most_counted, row_slices, shared_table, small_batches, text_or_empty, tidy, tidy_group

#: Bytes of packed postings for one task.
PART_BYTES = 12 << 20
#: Words whose counts are broadcast, at most (16 bytes each).
COUNTED = 100_000
#: Words with a place of their own, bins of equal mass, members of a class at most, groups of rarer words, and hashed rows for pairs of words.
TOP, CLASSES, MEMBERS, GROUPS, HASHED = 1024, 16, 32, 16, 1 << 13
#: Hashed weights inside classes: as many as there are words, between these bounds.
CELLS = (1 << 14, 1 << 18)
#: Taken off each count of a rare word, for the unknown one.
DISCOUNT = 0.75
#: Rounds; each takes its share of the documents, so that together they train on every position of every training document once.
#: Positions of an update: few at first, doubled after every STEPS updates up to BATCH, so that short partitions learn too.
ROUNDS, FIRST, STEPS, BATCH, RATE, RATE_INSIDE = 2, 1024, 8, 1 << 14, 0.1, 0.02
END = 1
#: Weights of a table that travel and are averaged together.
BLOCK = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def token_codes(texts):
    """(hashes of the distinct words, code of each token, bounds of the texts). An end token, coded as the last distinct word, closes each text."""
    import numpy as np
    import pandas as pd
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(bounds[0], bounds[-1] - bounds[0])
    full = pc.greater(pc.binary_length(flat), 0)
    bounds = np.concatenate([[0], np.cumsum(np.asarray(full))])[bounds - bounds[0]]
    coded = flat.filter(full).dictionary_encode()
    known = np.asarray(coded.dictionary.to_pylist(), dtype=object)
    hashes = np.append(pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64), np.uint64(END))
    codes = np.insert(coded.indices.to_numpy().astype(np.int64), bounds[1:], len(hashes) - 1)
    return hashes, codes, bounds + np.arange(len(bounds))


def _slices(batches):
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(1)
        for a, b in row_slices(pc.binary_length(texts).to_pylist()):
            yield batch.slice(a, b - a), token_codes(texts.slice(a, b - a))


def find(words, wanted):
    """Places of the wanted words in a sorted array, or its length."""
    import numpy as np

    if not len(words):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
    return np.where(words[at] == wanted, at, len(words))


def word_counts(rows: DataFrame) -> DataFrame:
    """word (hash), n: counts over the training texts, added up in each task before they move."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def given():
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for _, (hashes, codes, _) in _slices(batches):
            words, at = np.unique(np.concatenate([words, hashes]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.bincount(codes, minlength=len(hashes))]), len(words)).astype(np.int64)
            if len(words) > 1 << 19:
                yield given()
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield given()

    counted = rows.where("NOT held").select("key", "text").mapInArrow(tidy(run), "word long, n long")
    return counted.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


PACKED = "part int, words binary, keys binary, times binary, learned binary"
SUMS = "bucket int, keys binary, tokens binary, known binary, base binary, rare binary"
DOCUMENTS = "key long, tokens long, known long, base double, rare double"


def rare_sums(rows: DataFrame, listed, unknown, parts: int) -> DataFrame:
    """Per document (key), sums over its words that are not ``listed`` (sorted hashes): tokens, known ones, base (log10 of the count and one), rare (log10 of the discounted count, or of the unknown word's mass, ``unknown``). Postings of (key, text, held) meet by word; the sums are added up by document."""
    sent = rows.sparkSession.sparkContext.broadcast((listed, unknown))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch, (hashes, codes, bounds) in _slices(batches):
            other = (find(sent.value[0], hashes) == len(sent.value[0]))[codes]
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[other]
            pair, times = np.unique(row * len(hashes) + codes[other], return_counts=True)
            row, words = pair // len(hashes), hashes[pair % len(hashes)]
            keys, learned = batch.column(0).to_numpy()[row], ~np.asarray(batch.column(2))[row]
            part = (words % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts))
            cut = lambda x: pa.array([x[by[cuts[p] : cuts[p + 1]]].tobytes() for p in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), cut(words), cut(keys), cut(times.astype(np.int32)), cut(learned.astype(np.int8))], names=["part", "words", "keys", "times", "learned"])

    def meet(table):
        import numpy as np
        import pyarrow as pa

        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        words, keys, times, learned = joined("words", np.uint64), joined("keys", np.int64), joined("times", np.int32), joined("learned", np.int8)
        kinds, of = np.unique(words, return_inverse=True)
        c = np.bincount(of, times * learned, len(kinds))[of]
        docs, at = np.unique(keys, return_inverse=True)
        total = lambda x: np.bincount(at, times * x, len(docs))
        columns = {"keys": docs, "tokens": total(1).astype(np.int64), "known": total(c > 0).astype(np.int64), "base": total(np.log10(c + 1.0)), "rare": total(np.log10(np.where(c > 0, c - DISCOUNT, sent.value[1])))}
        bucket = docs.view(np.uint64) % np.uint64(parts)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(parts + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        out = {"bucket": pa.array(some, pa.int32())}
        return pa.table(out | {name: pa.array([values[by[cuts[p] : cuts[p + 1]]].tobytes() for p in some], pa.binary()) for name, values in columns.items()})

    def add(table):
        import numpy as np
        import pyarrow as pa

        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        keys, at = np.unique(joined("keys", np.int64), return_inverse=True)
        total = lambda c, kind: np.bincount(at, joined(c, kind), len(keys))
        whole = {c: total(c, np.int64).astype(np.int64) for c in ("tokens", "known")}
        return pa.table({"key": keys} | whole | {c: total(c, np.float64) for c in ("base", "rare")})

    packed = rows.select("key", "text", "held").mapInArrow(tidy(pack), PACKED)
    sums = packed.repartition(parts, "part").groupBy("part").applyInArrow(tidy_group(meet), SUMS)
    return sums.repartition(parts, "bucket").groupBy("bucket").applyInArrow(tidy_group(add), DOCUMENTS)


def group_of(words):
    """Group of a rare word: its hash's highest bits."""
    import numpy as np

    return (words >> np.uint64(60)).astype(np.int64)


class Model:
    """Words and classes, and the weights of both softmaxes. ``listed``: (word, count) of the broadcast words, the end token among them; ``tokens``, ``kinds``: of all training words."""

    def __init__(self, listed: list[tuple[int, int]], tokens: int, kinds: int):
        import numpy as np

        listed = sorted((w % 2**64, int(c)) for w, c in listed)
        self.listed, self.listed_counts = np.asarray([w for w, _ in listed], np.uint64), np.asarray([c for _, c in listed], np.float64)
        top = sorted(listed, key=lambda x: (-x[1], x[0]))[:TOP]
        if not any(w == END for w, _ in top):
            top = top[: TOP - 1] + [(END, dict(listed).get(END, 0))]
        top.sort()
        self.tokens, self.kinds = tokens, kinds
        self.words = np.asarray([w for w, _ in top], np.uint64)
        counts = np.asarray([c for _, c in top], np.float64)
        self._make_classes(counts)
        self._make_groups(counts)
        rare = max(tokens - counts.sum(), 0.0)
        prior = np.bincount(self.classes, np.append(counts, rare), self.kinds_of_class) + 1.0
        self.bias = np.log(prior / prior.sum()).astype(np.float32)
        slots = np.append(np.maximum(counts, 0.5), self.group_mass)
        # logarithms of shares, so that no sum of exponentials can overflow
        self.slot_bias = np.log(np.maximum(slots, 1e-9)).astype(np.float32)
        for own in self.members:
            self.slot_bias[own] -= np.log(np.exp(self.slot_bias[own].astype(np.float64)).sum())
        self.rows = 2 * (len(top) + 2) + HASHED
        self.weights = np.zeros((self.rows, self.kinds_of_class), np.float32)
        self.cells = 1 << int(np.clip(np.ceil(np.log2(max(kinds, 2))), np.log2(CELLS[0]), np.log2(CELLS[1])))
        self.inside = np.zeros(self.cells, np.float32)

    def _make_classes(self, counts) -> None:
        """Classes of the top words by descending count: a bin ends at its share of the mass or when it is full; the rare class and the end token's come last."""
        import numpy as np

        own = np.where(self.words == END, 0, counts)
        order = [i for i in np.argsort(-own, kind="stable") if self.words[i] != END]
        classes, members, mass, size, share = np.zeros(len(counts), np.int64), [], 0.0, 0, max(own.sum(), 1) / CLASSES
        for i in order:
            if not members or mass >= share or size >= MEMBERS:
                members.append([])
                mass, size = 0.0, 0
            members[-1].append(i)
            classes[i] = len(members) - 1
            mass, size = mass + own[i], size + 1
        self.rare_class = len(members)
        classes[self.words == END] = self.rare_class + 1
        self.classes = np.append(classes, self.rare_class)
        #: Slots of each class: places of top words, or of groups after them.
        self.members = [np.asarray(m) for m in members] + [len(counts) + np.arange(GROUPS), np.flatnonzero(self.words == END)]
        self.kinds_of_class = len(self.members)
        #: Position of each slot among its class's members.
        self.position = np.zeros(len(counts) + GROUPS, np.int64)
        for own in self.members:
            self.position[own] = np.arange(len(own))

    def _make_groups(self, counts) -> None:
        """Discounted counts of the groups of listed words that have no place; share of the rare class that is left to words that are not listed, their mass, and the unknown word's part of it."""
        import numpy as np

        known = self.listed_counts > 0
        placed = np.isin(self.listed, self.words)
        self.group_mass = np.bincount(group_of(self.listed), np.where(known & ~placed, self.listed_counts - DISCOUNT, 0), GROUPS)
        self.unknown = max(DISCOUNT * (self.kinds - int((counts > 0).sum())), 0.5)
        rest = max(self.tokens - self.listed_counts.sum() - DISCOUNT * (self.kinds - int(known.sum())), 0.0)
        self.other_mass = rest + self.unknown
        self.other_share = self.other_mass / (self.other_mass + self.group_mass.sum())
        self.group_mass = np.maximum(self.group_mass, 1e-9)  # groups without words get next to nothing

    def places(self, hashes):
        """Place among the top words of each distinct word, or the number of top words."""
        return find(self.words, hashes)

    def features(self, place, bounds):
        """Rows of the weight table for each token: the word before, the word two before, and both."""
        import numpy as np

        n = len(self.words) + 2
        one, two = _before(place, bounds, n - 1)
        both = (one * 7919 + two * 104729 + 13) * 2654435761 % (1 << 32) % HASHED
        return one, n + two, 2 * n + np.asarray(both)

    def log_shares(self, weights, features):
        """Natural log-probabilities of the classes, a row per token."""
        import numpy as np

        logits = self.bias + weights[features[0]] + weights[features[1]] + weights[features[2]]
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return logits

    def cells_of(self, contexts, slots):
        """Places in the table of hashed weights of contexts (mixed word hashes) with slots, a row per context."""
        import numpy as np

        with np.errstate(over="ignore"):
            of_slots = (((slots.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)).astype(np.int32)
        return (contexts[:, None] + of_slots) & np.int32(self.cells - 1)

    def member_shares(self, inside, kind: int, contexts):
        """(log-probabilities of a class's members, a row per token; the two cells of each)."""
        import numpy as np

        slots = self.members[kind]
        cells = [self.cells_of(c, slots) for c in contexts]
        logits = inside[cells[0]]
        logits += inside[cells[1]]
        logits += self.slot_bias[slots]
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return logits, cells

    def slots_of(self, place, words):
        """Each token's slot: its place, or that of its group."""
        import numpy as np

        return np.where(place < len(self.words), place, len(self.words) + group_of(words))


def _before(values, bounds, start):
    """Of each token, the values one and two before it in its text, or ``start``."""
    import numpy as np

    first = np.zeros(len(values), bool)
    first[bounds[:-1]] = True
    one = np.full(len(values), start, values.dtype)
    one[1:] = values[:-1]
    one[first] = start
    two = np.full(len(values), start, values.dtype)
    two[1:] = one[:-1]
    two[first] = start
    return one, two


def _contexts(words, bounds):
    """Mixed hashes of the word before and of the word two before each token, apart from each other."""
    import numpy as np

    one, two = _before(words, bounds, np.uint64(0))
    with np.errstate(over="ignore"):
        mixed = one * np.uint64(0xA0761D6478BD642F), (two ^ np.uint64(0xE7037ED1A0B428DB)) * np.uint64(0x8EBC6AF09C88C6E3)
    return tuple((x >> np.uint64(34)).astype(np.int32) for x in mixed)


def distinct(codes):
    """(place of the first of each distinct code, which of them each code is)."""
    import numpy as np
    import pandas as pd

    which, kinds = pd.factorize(codes)
    first = np.empty(len(kinds), np.int64)
    first[which[::-1]] = np.arange(len(codes))[::-1]
    return first, which


def _by_class(truth):
    """(class, indices of its tokens) of what occurs."""
    import numpy as np

    by = np.argsort(truth.astype(np.int16), kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], truth[by][1:] != truth[by][:-1], [True]])) if len(by) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(truth[by[a]]), by[a:b]


def strides(size: int, done: int):
    """(start, stop) of the updates over ``size`` positions, after ``done`` updates before them."""
    a = 0
    while a < size:
        b = min(size, a + min(BATCH, FIRST << (done // STEPS)))
        yield a, b
        a, done = b, done + 1


def train(rows: DataFrame, model: Model) -> None:
    """Rounds of gradient updates: each partition descends (Adagrad) from the same weights over its share of the round; changes are averaged by the tokens behind them."""
    import numpy as np

    spark = rows.sparkSession
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def descend(batches, sent=sent):
            import pyarrow as pa

            model = sent.value
            weights, inside = model.weights.copy(), model.inside.copy()
            seen, seen_inside, used, steps = np.full(model.rows, 1e-6, np.float32), np.full(model.cells, 1e-6, np.float32), 0, 0
            for _, (hashes, codes, bounds) in _slices(batches):
                words, place = hashes[codes], model.places(hashes)[codes]
                features, truth, slots = model.features(place, bounds), model.classes[place], model.slots_of(place, words)
                contexts = _contexts(words, bounds)
                inner = np.where((find(model.listed, hashes) == len(model.listed))[codes], -1, truth)
                for a, b in strides(len(place), steps):
                    some, steps = np.arange(a, b), steps + 1
                    # contexts are few beside tokens: a row for each, its share times its tokens, less the classes that came
                    first, which = distinct(features[0][some] * model.rows + features[1][some])
                    chosen, scale = [f[some[first]] for f in features], 1 / len(some) ** 0.5
                    slope = np.exp(model.log_shares(weights, chosen)) * np.bincount(which, minlength=len(first))[:, None].astype(np.float32)
                    slope -= np.bincount(which * model.kinds_of_class + truth[some], minlength=slope.size).reshape(slope.shape)
                    for f in chosen:
                        by = np.argsort(f, kind="stable")
                        starts = np.flatnonzero(np.concatenate([[True], f[by][1:] != f[by][:-1]]))
                        change = np.add.reduceat(slope[by], starts, axis=0) * np.float32(scale)
                        own = f[by][starts]
                        seen[own] += (change**2).mean(1)
                        weights[own] -= RATE * change / np.sqrt(seen[own])[:, None]
                    at, slopes = [], []
                    for kind, own in _by_class(inner[some]):
                        if kind < 0 or len(model.members[kind]) < 2:
                            continue
                        shares, cells = model.member_shares(inside, kind, [c[some[own]] for c in contexts])
                        slope = np.exp(shares)
                        slope[np.arange(len(own)), model.position[slots[some[own]]]] -= 1
                        at += [c.ravel() for c in cells]
                        slopes += [slope.ravel()] * 2
                    if at:
                        change = np.bincount(np.concatenate(at), np.concatenate(slopes), model.cells).astype(np.float32) * np.float32(scale)
                        seen_inside += change**2
                        inside -= RATE_INSIDE * change / np.sqrt(seen_inside)
                    used += len(some)
            tables = [(0, weights - model.weights), (1, inside - model.inside)]
            parts = [(kind, a // BLOCK, change.ravel()[a : a + BLOCK].astype(np.float16).tobytes()) for kind, change in tables for a in range(0, change.size, BLOCK)]
            columns = [pa.array([p[i] for p in parts], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([used] * len(parts), pa.int64())], names=["kind", "block", "delta", "used"])

        def add(form):
            def run(batches):
                import pyarrow as pa

                total: dict[tuple, list] = {}
                for batch in batches:
                    for kind, block, delta, used in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                        held = total.setdefault((kind, block), [0.0, 0])
                        change = np.frombuffer(delta, form).astype(np.float64)
                        held[0] = held[0] + (change * used if form == np.float16 else change)
                        held[1] += used
                columns = [pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([np.asarray(d, np.float32).tobytes() for d, _ in total.values()], pa.binary()), pa.array([u for _, u in total.values()], pa.int64())], names=["kind", "block", "delta", "used"])

            return tidy(run)

        kind = "kind int, block int, delta binary, used long"
        share = rows.where(~F.col("held") & (F.pmod(F.xxhash64(F.lit(31), "key"), F.lit(ROUNDS)) == turn)).select("key", "text")
        # block by block, and by salts before that, so that no task adds up all partitions
        salted = share.mapInArrow(tidy(descend), kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("kind", "block", "salt").drop("salt")
        for table, block, delta, used in salted.mapInArrow(add(np.float16), kind).repartition("kind", "block").mapInArrow(add(np.float32), kind).collect():
            if used:
                change = np.frombuffer(bytes(delta), np.float32) / used
                (model.weights if table == 0 else model.inside).reshape(-1)[block * BLOCK : block * BLOCK + len(change)] += change


def text_scores(model: Model, tokens):
    """Of each text: tokens, tokens that are not listed, known listed ones, their base sum, and the score but for the unlisted words' shares of their groups (log10)."""
    import numpy as np

    hashes, codes, bounds = tokens
    words, place = hashes[codes], model.places(hashes)[codes]
    features, truth, slots, contexts = model.features(place, bounds), model.classes[place], model.slots_of(place, words), _contexts(words, bounds)
    listed = find(model.listed, hashes)[codes]
    other = listed == len(model.listed)
    inner = np.where(other, -1, truth)
    score = np.empty(len(place))
    for a in range(0, len(place), 4 * BATCH):
        some = np.arange(a, min(a + 4 * BATCH, len(place)))
        first, which = distinct(features[0][some] * model.rows + features[1][some])
        score[some] = model.log_shares(model.weights, [f[some[first]] for f in features])[which, truth[some]]
        for kind, own in _by_class(inner[some]):
            if kind >= 0 and len(model.members[kind]) > 1:
                shares, _ = model.member_shares(model.inside, kind, [c[some[own]] for c in contexts])
                score[some[own]] += shares[np.arange(len(own)), model.position[slots[some[own]]]]
    score /= np.log(10)
    count = np.append(model.listed_counts, 0)[listed]
    grouped = (place == len(model.words)) & ~other
    score += np.where(grouped, np.log10(max(1 - model.other_share, 1e-12)) + np.log10(np.maximum(count - DISCOUNT, 0.25)) - np.log10(model.group_mass)[group_of(words)], 0)
    score += np.where(other, np.log10(model.other_share) - np.log10(model.other_mass), 0)
    total = lambda x: np.add.reduceat(x, bounds[:-1])
    return np.diff(bounds), total(other.astype(np.int64)), total((count > 0).astype(np.int64)), total(np.where(other, 0, np.log10(count + 1))), total(score)


def class_scores(rows: DataFrame, model: Model) -> DataFrame:
    """key, id, held and ``text_scores`` of each text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch, tokens in _slices(batches):
            columns = text_scores(sent.value, tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), *map(pa.array, columns)], names=["key", "id", "held", "n_tokens", "n_other", "n_listed", "listed_base", "score"])

    return rows.mapInArrow(tidy(run), "key long, id long, held boolean, n_tokens long, n_other long, n_listed long, listed_base double, score double")


def fit(rows: DataFrame) -> Model:
    """The model of rows (key, text, held): counts over all training texts, then weights."""
    counts = shared_table(word_counts(rows), "word-counts")
    kinds, tokens = counts.agg(F.count(F.lit(1)), F.sum("n")).head()
    listed = most_counted(counts, COUNTED).select("word", "n").toArrow()
    pairs = dict(zip(listed.column("word").to_pylist(), listed.column("n").to_pylist(), strict=True))
    pairs |= {r["word"]: r["n"] for r in counts.where(F.col("word") == END).collect()}  # the end token always, as every text has it
    pairs.setdefault(END, 0)
    model = Model(list(pairs.items()), tokens or 0, kinds or 0)
    train(rows, model)
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null text counts as empty: its one token is the end. Null ids belong to
    the training documents or not by the crc32 of an empty text. Repeated
    rows count as often as they occur. Empty input: no rows. Without training
    documents every word is unknown. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), text.alias("text"), held_out(F.col(id_col)).alias("held"), F.col(id_col).cast("long").alias("id"))
    model = fit(rows)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    letters = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).head()[0] or 0
    of_doc = shared_table(rare_sums(rows, model.listed, model.unknown, max(least, -(-letters // PART_BYTES))).withColumnRenamed("key", "of"), "document-sums")
    joined = class_scores(rows, model).join(of_doc, F.col("key") == F.col("of"), "left")
    # rows that agree in id and text have one key: each gets its share of the key's sums
    own = lambda c: F.coalesce(F.col(c) * F.col("n_other") / F.col("tokens"), F.lit(0.0))
    return joined.select(
        "id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_listed") + F.round(own("known")).cast("long")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("listed_base") + own("base") - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.kinds + 1)))).alias("base_score"), (F.col("score") + own("rare")).alias("score"),
    )
