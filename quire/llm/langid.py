"""Language identification with character language models.

One interpolated Kneser-Ney model per language, over the characters of
white-space separated words (with a start and an end mark). Per order there
is one sorted array of n-gram hashes, and for each of them the languages that
know it with their values, so that rare n-grams cost no column per language.
A document gets the language of lowest cross-entropy per character; how
sharply entropies turn into probabilities, and from what entropy on a text is
rejected, is calibrated on labelled documents that the counts have not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_slices, shared_table, small_batches, text_or_empty, tidy, words, worker_cache

ORDER = 5
#: Labelled documents per language that the models are counted on, and calibrated on.
COUNTED, CALIBRATED = 500, 100
#: Characters of a sampled document, about: of longer ones a share of the words is drawn, from all over the text. Sampled words have at most WORD_CHARS characters.
SAMPLED_CHARS, WORD_CHARS = 20_000, 64
#: Characters of the pieces of texts from which the limit of short texts is calibrated.
SHORT_CHARS = 40
#: Probabilities held at a time while words are scored.
CELLS = 1_000_000
#: Languages up to which an n-gram has a value for each of them; with more, only for those that know it.
DENSE = 16
#: Words whose scores a Python worker holds.
CACHED = 200_000
#: Labels up to which their shares are broadcast.
LABELS_BROADCAST = 100_000
UNKNOWN = "und"
START, STOP = "\x02", "\x03"


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the document is kept from learning: crc32 of its id's text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def _grams(found: list[str]):
    """Characters of the marked words: position in its word, number of its word, and n-gram hashes that end there, by order (0: the empty one)."""
    import numpy as np

    marked = [START + w + STOP for w in found]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), lengths)
    at = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    odd = np.uint64(0x9E3779B97F4A7C15)
    hashes, power = [np.zeros(len(chars), np.uint64)], np.uint64(1)
    for n in range(1, ORDER + 1):
        back = np.zeros(len(chars), np.uint64)
        back[n - 1 :] = chars[: max(0, len(chars) - n + 1)]
        with np.errstate(over="ignore"):
            power = np.uint64((int(power) * int(odd)) % 2**64)
            mixed = (back + np.uint64(1)) * power
            hashes.append(hashes[-1] + (mixed ^ (mixed >> np.uint64(29))))
    return at, word, hashes


class Grams:
    """The n-grams of one length: a sorted array of hashes, with their discounted shares and, as contexts of longer ones, their back-off weights in each language."""

    def __init__(self, shares: list, weights: list):
        import numpy as np

        self.languages = len(shares)
        sides = []
        for columns in (shares, [(k, v - 1) for k, v in weights]):
            sides.append((np.concatenate([k for k, _ in columns]), np.repeat(np.arange(len(columns)), [len(k) for k, _ in columns]), np.concatenate([v for _, v in columns]).astype(np.float32)))
        self.keys, at = np.unique(np.concatenate([k for k, _, _ in sides]), return_inverse=True)
        self.begins = np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        self.begins = np.append(self.begins, len(self.keys))
        self.steps = int(np.diff(self.begins).max(initial=0)).bit_length()
        places = at[: len(sides[0][0])], at[len(sides[0][0]) :]
        self.values = [self._laid(place, language, value) for place, (_, language, value) in zip(places, sides, strict=True)]

    def _laid(self, place, language, value):
        """Values by key: a row for each, or, with many languages, (bounds, languages, values)."""
        import numpy as np

        if self.languages <= DENSE:
            rows = np.zeros((len(self.keys) + 1, self.languages), np.float32)
            rows[place, language] = value
            return rows
        by = np.argsort(place, kind="stable")
        return np.searchsorted(place[by], np.arange(len(self.keys) + 2)), language[by].astype(np.int32), value[by]

    def find(self, wanted):
        """Place of each hash, or the number of keys: a binary search among those with the same first bits."""
        import numpy as np

        first = (wanted >> np.uint64(48)).astype(np.int64)
        low, high = self.begins[first], self.begins[first + 1]
        if not len(self.keys):
            return low
        for _ in range(self.steps):
            mid = (low + high) >> 1
            less = (mid < high) & (self.keys[np.minimum(mid, len(self.keys) - 1)] < wanted)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        return np.where(self.keys[np.minimum(low, len(self.keys) - 1)] == wanted, low, len(self.keys))

    def rows(self, side: int, at):
        """Values (0: shares, 1: weights less one) at places, a row each."""
        import numpy as np

        if self.languages <= DENSE:
            return self.values[side][at]
        bounds, language, value = self.values[side]
        counts = bounds[at + 1] - bounds[at]
        ends = np.cumsum(counts)
        entries = np.repeat(bounds[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        out = np.zeros((len(at), self.languages), np.float32)
        out[np.repeat(np.arange(len(at)), counts), language[entries]] = value[entries]
        return out


class CharModels:
    """Sorted hash arrays. Per order: n-grams with their discounted shares, contexts with their back-off weights; a column per language."""

    def __init__(self, languages: list[str], counts: dict[str, list[tuple[str, int]]]):
        import numpy as np

        self.languages, self.sharpness, self.most_entropy = languages, 1.0, float("inf")
        shares: list[list] = [[] for _ in range(ORDER)]
        weights: list[list] = [[] for _ in range(ORDER)]
        alphabet: set[str] = set()
        for lang in languages:
            found = [w for w, _ in counts[lang]]
            alphabet.update(*found)
            at, word, hashes = _grams(found)
            times = np.asarray([n for _, n in counts[lang]], np.float64)[word] if found else np.zeros(0)
            for n in range(1, ORDER + 1):
                own = np.flatnonzero((at >= n - 1) & (at > 0))
                keys, first, inverse = np.unique(hashes[n][own], return_index=True, return_inverse=True)
                count = np.bincount(inverse, times[own], len(keys))
                context = np.where(own[first] > 0, hashes[n - 1][own[first] - 1], 0) if n > 1 else np.zeros(len(keys), np.uint64)
                if n < ORDER:  # how many characters stand before it, unless it begins a word
                    longer = np.flatnonzero(at >= n)
                    _, one = np.unique(hashes[n + 1][longer], return_index=True)
                    kinds = np.zeros(len(keys))
                    np.add.at(kinds, np.searchsorted(keys, hashes[n][longer[one]]), 1)
                    count = np.where(at[own[first]] == n - 1, count, kinds)
                count = np.maximum(count, 1e-9)
                ones, twos = (count == 1).sum(), (count == 2).sum()
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
                contexts, of = np.unique(context, return_inverse=True)
                total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, np.minimum(count, discount), len(contexts))
                shares[n - 1].append((keys, np.maximum(count - discount, 0) / total[of]))
                weights[n - 1].append((contexts, kinds / total))
        self.floor = 1.0 / (len(alphabet) + 2)
        # an n-gram of one order is a context of the next: both values are found at once
        nothing = [(np.zeros(0, np.uint64), np.zeros(0))] * len(languages)
        self.tables = [Grams(shares[n - 1] if n else nothing, weights[n] if n < ORDER else nothing) for n in range(ORDER + 1)]
        self.slack = 0.0

    def score_words(self, found: list[str]):
        """A row per word: natural log-probability under each language, then the characters counted. Words without letters count nothing."""
        import numpy as np

        out = np.zeros((len(found), len(self.languages) + 1), np.float32)
        known = [i for i, w in enumerate(found) if any(map(str.isalpha, w))]
        if not known:
            return out
        at, word, hashes = _grams([found[i] for i in known])
        p = np.full((len(at), len(self.languages)), self.floor, np.float32)
        places = [self.tables[0].find(hashes[0])]
        for n in range(1, ORDER + 1):
            rows = np.flatnonzero((at >= n - 1) & (at > 0))
            places.append(self.tables[n].find(hashes[n]))
            backed = p[rows] * (1 + self.tables[n - 1].rows(1, places[n - 1][rows - 1]))
            p[rows] = backed + self.tables[n].rows(0, places[n][rows])
        p[at == 0] = 1
        log = np.log(np.maximum(p, 1e-30))
        bounds = np.flatnonzero(at == 0)
        out[known, :-1] = np.add.reduceat(log, bounds, axis=0)
        out[known, -1] = np.diff(np.append(bounds, len(at))) - 1
        return out

    def entropies(self, texts, memo):
        """A row per text of an Arrow array: cross-entropy per character under each language; the texts' characters."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        rows = memo.look(coded.dictionary.to_pylist())
        which, bounds = coded.indices.to_numpy(), bounds - bounds[0]
        sums = np.empty((len(texts), rows.shape[1]))
        for i in range(rows.shape[1]):
            run = np.concatenate([[0.0], np.cumsum(rows[:, i][which], dtype=np.float64)])
            sums[:, i] = run[bounds[1:]] - run[bounds[:-1]]
        return -sums[:, :-1] / np.maximum(sums[:, -1:], 1), sums[:, -1]

    def memo(self) -> "Scores":
        return Scores(self)

    def calibrate(self, labelled: list[tuple[str, str]]) -> None:
        """Fit, on labelled texts, how sharply entropies differ (by likelihood of the labels) and the highest entropy that is accepted.

        The limit lies halfway between what nearly all texts have under the
        right language and the middle of what texts have that none of the
        models was made for: the texts under the best of the wrong languages,
        and the texts with their characters in disorder, whichever is lower.
        Short texts get what pieces of texts have above that, by the square
        root of their length.
        """
        import numpy as np
        import pyarrow as pa

        pairs = [(lang, text) for lang, text in labelled if lang in self.languages and any(map(str.isalpha, text))]
        if not pairs:
            return
        memo = self.memo()
        h, n = self.entropies(pa.array([t for _, t in pairs], pa.string()), memo)
        truth = np.asarray([self.languages.index(lang) for lang, _ in pairs])
        own = h[np.arange(len(pairs)), truth]
        best = (np.inf, 1.0)
        for sharp in np.geomspace(0.5, 200, 40):
            best = min(best, (float((sharp * own + np.log(np.exp(-sharp * (h - h.min(1, keepdims=True))).sum(1)) - sharp * h.min(1)).sum()), float(sharp)))
        self.sharpness = best[1]
        draw = np.random.default_rng(13)
        mixed = ["".join(draw.permutation(list(t[:2000]))) for _, t in pairs]
        foreign = [float(np.median(self.entropies(pa.array(mixed, pa.string()), memo)[0].min(1)))]
        if len(self.languages) > 1:
            h[np.arange(len(pairs)), truth] = np.inf
            foreign.append(float(np.median(h.min(1))))
        usual = float(np.quantile(own, 0.995))
        self.most_entropy = usual + max(0.05 * usual, (min(foreign) - usual) / 2)
        pieces = [(k, t[a : a + SHORT_CHARS].rpartition(" ")[0]) for k, (_, t) in enumerate(pairs) for a in (0, len(t) // 2)]
        pieces = [(k, t) for k, t in pieces if any(map(str.isalpha, t))]
        if pieces:
            short, size = self.entropies(pa.array([t for _, t in pieces], pa.string()), memo)
            above = short[np.arange(len(pieces)), truth[[k for k, _ in pieces]]] - self.most_entropy
            self.slack = max(0.0, float(np.quantile(above * np.sqrt(size), 0.995)))

    def key(self) -> str:
        """A digest of the models, by which workers tell them apart."""
        import hashlib
        import pickle

        return hashlib.blake2b(pickle.dumps((self.languages, self.tables, self.sharpness, self.most_entropy, self.slack)), digest_size=12).hexdigest()

    def decide(self, texts, memo):
        """(languages, probabilities, rejected) of an Arrow array of texts."""
        import numpy as np

        h, n = self.entropies(texts, memo)
        lead = np.exp(-self.sharpness * (h - h.min(1, keepdims=True)))
        best = h.argmin(1)
        return [self.languages[i] for i in best], 1 / lead.sum(1), (h.min(1) > self.most_entropy + self.slack / np.sqrt(np.maximum(n, 1))) | (n == 0)


class Scores:
    """Rows of ``score_words`` by word; when CACHED words are held, all are let go."""

    def __init__(self, models: CharModels):
        self.models = models
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.places: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.models.languages) + 1), np.float32)

    def look(self, words: list[str]):
        import itertools

        import numpy as np

        if len(self.places) > CACHED:
            self.clear()
        at = np.fromiter(map(self.places.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            step = max(64, CELLS // (10 * len(self.models.languages)))
            at[new] = np.arange(len(fresh)) + len(self.rows)
            self.rows = np.concatenate([self.rows, *(self.models.score_words(fresh[a : a + step]) for a in range(0, len(fresh), step))])
            self.places.update(zip(fresh, at[new].tolist(), strict=True))
        return self.rows[at]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", counted: int = COUNTED, calibrated: int = CALIBRATED) -> CharModels:
    """Models from labelled documents that are not held out, one for every label.

    Documented bounds: per language at most ``counted`` documents for the
    counts and ``calibrated`` others (a sixth of them, if there are fewer)
    for the calibration, drawn by a hash of id and text (rows that agree in
    both are drawn once), each of about SAMPLED_CHARS characters at most,
    drawn word by word from the whole text. So the arrays' size is bounded by
    the number of languages.
    """
    from pyspark.sql import Window

    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(lang_col).isNotNull() & text.isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.lit(5), F.col(id_col), text).alias("h"))
    sizes = shared_table(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "labels")
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return CharModels([UNKNOWN], {UNKNOWN: []})
    sizes = sizes.select(F.col("lang").alias("label"), "n")
    place = (F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)).alias("place")
    share = F.lit(1.3 * (counted + calibrated)) / F.col("n")
    # the share leaves a bounded number of rows per language, which are then ranked
    drawn = rows.select("lang", "text", "h", place).join(F.broadcast(sizes) if len(languages) <= LABELS_BROADCAST else sizes, F.col("lang") == F.col("label")).where(F.col("place") < share)
    drawn = drawn.select("lang", "n", "h", "place", _sampled_words(F.col("text")).alias("words")).groupBy("lang", "h").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.first("words").alias("words"))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "h")))
    apart = F.least(F.lit(calibrated), F.expr("n div 6"))
    used = F.when(F.col("nth") <= apart, "calibrate").when(F.col("nth") <= apart + counted, "count")
    drawn = shared_table(drawn.select("lang", "words", used.alias("used")).where("used IS NOT NULL"), "labelled")
    counts: dict[str, list] = {x: [] for x in languages}
    table = drawn.where("used = 'count'").select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        if any(map(str.isalpha, word)):
            counts[lang].append((word, n))
    models = CharModels(languages, counts)
    held = drawn.where("used = 'calibrate'").select("lang", F.array_join("words", " ").alias("text")).toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    models.calibrate(list(zip(held.column("lang").to_pylist(), held.column("text").to_pylist(), strict=True)))
    return models


def _sampled_words(text: Column) -> Column:
    """Lower-cased words of a text; of a long one, those that a hash of word and place draws from all of it."""
    share = (F.lit(float(SAMPLED_CHARS << 20)) / F.greatest(F.length(text), F.lit(SAMPLED_CHARS))).cast("long")
    drawn = lambda most: F.filter(words(F.lower(text)), lambda w, i: (F.length(w) <= WORD_CHARS) & (F.pmod(F.xxhash64(w, i), F.lit(1 << 20)) < most))
    # the share is bound once per text: inside the filter it would be computed for every word
    return F.when(F.length(text) <= SAMPLED_CHARS, F.filter(words(F.lower(text)), lambda w: F.length(w) <= WORD_CHARS)).otherwise(let(share, drawn))


def _decider(rows: DataFrame, models: CharModels, carried: list[str], field: int = 0):
    """A function over Arrow batches with a column ``text``, or ``record`` with such a field: lang_pred, score, rejected, and the carried columns as they are."""
    small_batches(rows.sparkSession)
    sent, name = rows.sparkSession.sparkContext.broadcast(models), models.key()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            memo = worker_cache("langid", name, lambda: sent.value.memo())
            texts = batch.column("text") if "text" in batch.schema.names else pc.fill_null(pc.struct_field(batch.column("record"), [field]).cast(pa.string()), "")
            for a, b in row_slices(pc.binary_length(texts).to_pylist()):
                langs, scores, rejected = sent.value.decide(texts.slice(a, b - a), memo)
                kept = [batch.column(c).slice(a, b - a) for c in carried]
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), *kept], names=["lang_pred", "score", "rejected", *carried])

    return tidy(run)


def identify(docs: DataFrame, models: CharModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1), rejected: one row per input row, from the whole text alone.

    ``und`` with score 0, and rejected, if the text is null, empty or has no
    letter. Otherwise a learned language, ``rejected`` if its entropy is
    beyond the calibrated limit. Repeated rows and null ids: row by row.
    """
    text = text_or_empty(F.col(text_col))
    found = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    found = found.mapInArrow(_decider(found, models, ["id", "letters"]), "lang_pred string, score double, rejected boolean, id long, letters boolean")
    return found.select(
        "id",
        F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        (F.col("rejected") | ~F.col("letters")).alias("rejected"),
    )


def keep_identified(docs: DataFrame, models: CharModels, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns: the records travel with their texts, so nothing is joined. Rows without letters are rejected."""
    text = text_or_empty(F.col(f"`{text_col}`"))
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.where(text.rlike(r"\p{L}")).select(record.alias("record"))
    kind = rows.schema["record"].dataType.simpleString()
    found = rows.mapInArrow(_decider(rows, models, ["record"], docs.columns.index(text_col)), f"lang_pred string, score double, rejected boolean, record {kind}")
    return found.where("NOT rejected").select("record.*")
