"""Packing of tokenised documents into fixed windows.

Bounded-space online packing, per partition: a fixed number of windows is
open, a piece goes where it fits best, and where it fits nowhere the fullest
window is emitted to make room. What is still open at the end of a partition
is merged with other partitions' leftovers, longest pieces first. Pieces are
at most a window long; only documents longer than a window are cut.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, row_slices, shared_table, small_batches, text_or_empty, tidy, worker_cache

WINDOW = 2048
END = 1
#: Marks that may end a word.
MARKS = ".,!?;:"
#: Bytes of texts that are encoded at a time: the more, the more often a word is met again.
SLICE = 6 << 20
#: Words held by a Python worker.
CACHED = 200_000
#: Windows whose pieces one merging task takes.
MERGE_WINDOWS = 4096
PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
MERGED = 1 << 61


class Windows:
    """Open windows by free room. ``put`` returns the windows that are thereby finished; a window is a list of pieces."""

    def __init__(self, most: int, room: int):
        self.most, self.room = most, room
        self.free: list[tuple[int, int]] = []  # (free room, window), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def put(self, length: int, piece) -> list[list]:
        done = []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            left, key = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                done.append(self.held.pop(self.free.pop(0)[1]))  # the fullest has the least room
            left, key, self.made = self.room, self.made, self.made + 1
            self.held[key] = []
        self.held[key].append(piece)
        if left == length:
            done.append(self.held.pop(key))
        else:
            insort(self.free, (left - length, key))
        return done

    def rest(self) -> list[list]:
        return [self.held[k] for _, k in self.free]


def ranges(begins, counts):
    """All numbers of the ranges that begin there and have so many."""
    import numpy as np

    ends = np.cumsum(counts)
    return np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def runs(words):
    """Whether each word of an Arrow array is letters only, lower case, and below the combining marks, so that normalising leaves it as it is."""
    import numpy as np
    import pyarrow.compute as pc

    plain = np.asarray(pc.and_(pc.string_is_ascii(words), pc.and_(pc.ascii_is_alpha(words), pc.ascii_is_lower(words))))
    at = np.flatnonzero(~plain & ~np.asarray(pc.string_is_ascii(words)))
    if len(at):
        odd = words.take(at)
        low = pc.and_(pc.and_(pc.utf8_is_alpha(odd), pc.utf8_is_lower(odd)), pc.equal(pc.utf8_lower(odd), odd))
        plain[at] = np.asarray(pc.and_(low, pc.match_substring_regex(odd, r"^[\x{0}-\x{24f}]+$")))
    return plain


class Words:
    """Ids of white-space separated words. What was encoded is kept: places by word, and ids in one array; when CACHED words are held, all are let go."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.tokenize = self.encoder.model.tokenize
        # A word of lower-case composed letters alone is one match of the splitting pattern and
        # normalised as it is: the model can have it at once, its bytes as the byte-level alphabet has them.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.byte_chars = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.places: dict[str, int] = {}
        self.begins, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encoded(self, words: list[str]):
        """(counts, ids) of new words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(words, pa.string())
        run, ascii_ = runs(known), np.asarray(pc.string_is_ascii(known))
        tokenize, chars = self.tokenize, self.byte_chars
        found: list = [None] * len(words)
        rest = np.flatnonzero(~run).tolist()
        for i, e in zip(rest, self.encoder.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        for i in np.flatnonzero(run & ~ascii_).tolist():
            found[i] = [t.id for t in tokenize(words[i].encode().decode("latin-1").translate(chars))]
        for i in np.flatnonzero(run & ascii_).tolist():
            found[i] = [t.id for t in tokenize(words[i])]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum()))

    def look(self, words: list[str]):
        """(begins, counts) in ``ids`` of distinct words; call for all that is needed before ``ids`` is read."""
        import numpy as np

        at = np.fromiter(map(self.places.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            counts, ids = self.encoded(fresh)
            at[new] = np.arange(len(fresh)) + len(self.begins)
            self.places.update(zip(fresh, at[new].tolist(), strict=True))
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(counts) - counts])
            self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        return self.begins[at], self.counts[at]


def word_ids(path: str) -> Words:
    return Words(path)


def _parted(known):
    """(distinct cores, each word's core, distinct tails, each word's tail) of a dictionary of words: a run of marks after a letter or digit is encoded apart from what it follows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    core = pc.ascii_rtrim(known, characters=MARKS)
    size = np.asarray(pc.binary_length(core))
    ends = (size < np.asarray(pc.binary_length(known))) & (size > 0)
    ascii_ = np.asarray(pc.string_is_ascii(core))
    apart = ends & ascii_ & np.asarray(pc.ascii_is_alnum(pc.utf8_slice_codeunits(core, -1)))
    odd = np.flatnonzero(ends & ~ascii_)
    apart[odd] = runs(core.take(odd))
    mask = pa.array(apart)
    cores = pc.if_else(mask, core, known).dictionary_encode()
    tails = pc.if_else(mask, pc.struct_field(pc.extract_regex(pc.if_else(mask, known, "."), f"(?P<t>[{MARKS}]+)$"), "t"), "").dictionary_encode()
    return cores.dictionary.to_pylist(), np.asarray(cores.indices), tails.dictionary.to_pylist(), np.asarray(tails.indices)


def token_arrays(texts, words: Words):
    """Ids of each text, its end token included: (all ids in one array, bounds of the texts in it).

    The tokenizer drops white space and never merges across it, so each
    distinct word of the slice is encoded once.
    """
    import numpy as np
    import pyarrow.compute as pc

    # the tokenizer lower-cases too, but looks for its special marks in the text as it is
    marked = pc.any(pc.match_substring(texts, "<|")).as_py()
    split = pc.ascii_split_whitespace(texts if marked else pc.ascii_lower(texts))
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds -= bounds[0]
    if len(words.places) > CACHED:
        words.clear()
    cores, core, tails, tail = _parted(coded.dictionary)
    begins, counts = words.look(cores + [t for t in tails if t])
    at_tail = np.zeros(len(tails), np.int64)
    at_tail[[i for i, t in enumerate(tails) if t]] = len(cores) + np.arange(sum(map(bool, tails)))
    tail_counts = np.where([bool(t) for t in tails], counts[at_tail] if len(counts) else 0, 0) if tails else np.zeros(0, np.int64)
    # the ids of each distinct word: its core's, then its tail's; the end token comes last
    pair_begins = np.stack([begins[core], begins[at_tail][tail]], 1).ravel() if len(core) else np.zeros(0, np.int64)
    pair_counts = np.stack([counts[core], tail_counts[tail]], 1).ravel() if len(core) else np.zeros(0, np.int64)
    blob = np.append(words.ids[ranges(pair_begins, pair_counts)], np.uint32(END)).astype("<u4")
    lengths = np.append(pair_counts.reshape(-1, 2).sum(1), 1)
    firsts = np.cumsum(lengths) - lengths
    which = np.insert(coded.indices.to_numpy().astype(np.int64), bounds[1:], len(lengths) - 1)
    ids = blob[ranges(firsts[which], lengths[which])]
    # the end token of text i stands after its words: at bounds[i + 1] + i
    return ids, np.concatenate([[0], np.cumsum(lengths[which])[bounds[1:] + np.arange(len(bounds) - 1)]])


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open"]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _laid(window: list, key: int, is_open: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in window:
        out.append((doc, start, ids, total, key, offset, is_open))
        offset += len(ids) // 4
    return out


def pack_online(docs: DataFrame, tokenizer: str, window: int, most_open: int) -> DataFrame:
    """First pass over (id, text): packed pieces of each partition; ``open``: of windows left open at its end."""

    def run(batches):
        from pyspark import TaskContext

        memo = worker_cache("words", tokenizer, lambda: word_ids(tokenizer))
        base = TaskContext.get().partitionId() << 32
        windows, rows, made, held = Windows(most_open, window), [], 0, 0
        for batch in gathered(batches, SLICE):
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in row_slices(_sizes(texts), SLICE):
                ids, bounds = token_arrays(texts.slice(a, b - a), memo)
                for k in range(b - a):
                    begin, end = int(bounds[k]), int(bounds[k + 1])
                    for start in range(begin, end, window):
                        piece = ids[start : min(start + window, end)].tobytes()
                        for done in windows.put(len(piece) // 4, (ids_of[a + k], start - begin, piece, end - begin)):
                            rows += _laid(done, base + made, False)
                            made += 1
                            held += window * 4
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        for left in windows.rest():
            rows += _laid(left, base + made, True)
            made += 1
        yield _batch(rows)

    return docs.mapInArrow(tidy(run), PIECES)


def _sizes(texts):
    import numpy as np
    import pyarrow.compute as pc

    return np.asarray(pc.binary_length(texts)).tolist()


def merge_leftovers(pieces: DataFrame, window: int) -> DataFrame:
    """Second pass: the pieces of open windows, packed anew per partition, longest first."""

    def run(batches):
        from pyspark import TaskContext

        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        rows.sort(key=lambda r: (-len(r[2]), r[0] is None, r[0] or 0, r[1], r[2]))
        base = MERGED + (TaskContext.get().partitionId() << 32)
        windows, done = Windows(len(rows) + 1, window), []
        for doc, start, ids, total in rows:
            done += windows.put(len(ids) // 4, (doc, start, ids, total))
        done += windows.rest()
        for a in range(0, len(done), 256):
            yield _batch([r for i, w in enumerate(done[a : a + 256]) for r in _laid(w, base + a + i, False)])

    return pieces.mapInArrow(tidy(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_open: int = 128) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null text counts as empty: one piece, the end token alone. Null ids and
    repeated rows are packed like any other row. Empty input: no rows. Other
    columns are not read. ``most_open`` bounds the open windows of a task.
    """
    small_batches(docs.sparkSession)
    first = shared_table(pack_online(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text")), tokenizer, window, most_open), "pieces")
    left = first.where("open")
    tasks = -(-left.where("offset = 0").count() // MERGE_WINDOWS)
    out = first.where("not open")
    if tasks:
        out = out.unionByName(merge_leftovers(left.repartition(tasks, F.xxhash64("doc_id", "start", "sequence_id")), window))
    return out.drop("open")
