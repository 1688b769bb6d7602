"""Set similarity join of documents by word shingles, at a Jaccard similarity of 3/4.

Prefix filtering under several global token orders. A token is the 64-bit
hash of a shingle, so each order is a permutation of hashes: ascending and
descending, both with the very frequent tokens last. Documents whose sets are
equal are one node. Steps:

1. A document stays only if enough tokens of its prefix occur in other
   prefixes: as many as its prefix shares with that of any partner at 3/4.
2. Pairs must share enough prefix tokens under the first order and under the
   second; the two filters are intersected. A token of many documents ties
   them to a hub of its own instead of making all pairs; such ties count only
   for documents that both orders make a candidate.
3. What is connected so far is a family, in which whole sets are verified
   exactly; verified links give the components.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_counted, row_slices, shared_table, small_batches, text_or_empty, tidy, tidy_group, tidy_pair
from .families import family_components, small
from .graph import components, labels

SHINGLE = 5
#: A token is frequent if FREQUENT of the sampled documents hold it, one of SAMPLE being sampled; at most MOST_FREQUENT tokens are. This only orders tokens.
FREQUENT, SAMPLE, MOST_FREQUENT = 4, 16, 500_000
#: Documents that share a token: up to so many, all their pairs; beyond, ties to a hub.
ALL_PAIRS = 32
#: Pairs that are counted at a time.
PAIRS = 500_000
#: Tokens that are held at a time while sets are compared.
COMPARED = 1 << 20
#: Ratio of a band of set sizes, a little above that of the sizes of linked sets.
BAND = 1.34
#: Candidate ids up to which they are broadcast (8 bytes each); beyond, they are joined by a shuffle.
IDS_BROADCAST = 2_000_000
#: Bytes of packed postings for one task.
PART_BYTES = 6 << 20


def prefix_size(n):
    """Tokens of a set of n that are looked at: a quarter, which a partner may lack, and a sixteenth, of which some must be shared."""
    return (5 * n) // 16 + 1


@lru_cache(1 << 16)
def prefix_shared(n: int) -> int:
    """Tokens that the prefix of a set of n shares at least with the prefix of a partner at 3/4, whatever the partner's size.

    Of o common tokens the k-th comes at n - o + k at the latest in a set of
    n, so both prefixes hold it as long as that is within either's size.
    """
    import numpy as np

    m = np.arange(-(-3 * n // 4), 4 * n // 3 + 1)
    common = -(-3 * (n + m) // 7)
    return int((np.minimum(prefix_size(n) - n, prefix_size(m) - m) + common).min())


def token_sets(texts):
    """Sorted distinct tokens of each text of an Arrow array, one array per text."""
    import numpy as np
    import pandas as pd
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds -= bounds[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
    known = np.asarray(coded.dictionary.to_pylist(), dtype=object)
    hashes = pd.util.hash_array(known, categorize=False)[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    mixed = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            mixed = (mixed ^ hashes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(mixed[a : b - SHINGLE + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    short = (short ^ h) * np.uint64(0x9E3779B97F4A7C15)
                    short ^= short >> np.uint64(32)
                out.append(np.asarray([short], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens) -> int:
    """The node of a set: a 64-bit digest of its sorted tokens."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _is_in(frequent, tokens):
    import numpy as np

    if not len(frequent):
        return np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return frequent[at] == tokens


def prefix(tokens, frequent, order: int):
    """The first tokens of a sorted set under order 0 (ascending) or 1 (descending), frequent ones last."""
    import numpy as np

    size = prefix_size(len(tokens))
    late = _is_in(frequent, tokens)
    step = -1 if order else 1
    return np.concatenate([tokens[~late][::step], tokens[late][::step]])[:size]


def _sets(batches):
    """(ids, sets) of slices of bounded size."""
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(1)
        for a, b in row_slices(pc.binary_length(texts).to_pylist()):
            yield batch.column(0).slice(a, b - a), token_sets(texts.slice(a, b - a))


def frequent_tokens(rows: DataFrame):
    """Sorted array of the tokens that FREQUENT or more of the sampled documents hold, the most frequent of them."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for _, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], names=["token"])

    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "id", F.length("text")), F.lit(SAMPLE)) == 0)
    counted = shared_table(sample.mapInArrow(tidy(run), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT), "frequent-tokens")
    found = most_counted(counted, MOST_FREQUENT).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.view(np.uint64))


def document_nodes(rows: DataFrame, frequent) -> DataFrame:
    """id, n (set size), node (null if empty) and needed: tokens of the prefix, besides frequent ones, that must occur elsewhere."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        import pyarrow as pa

        for ids, sets in _sets(batches):
            needed = [prefix_shared(len(s)) - int(_is_in(sent.value, prefix(s, sent.value, 0)).sum()) for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(needed, pa.int64())], names=["id", "n", "node", "needed"])

    return rows.mapInArrow(tidy(run), "id long, n long, node long, needed long")


class _Packer:
    """Postings, packed by ranges of tokens into binary columns."""

    def __init__(self, parts: int, most: int = 1 << 19):
        self.parts, self.most, self.held, self.size = parts, most, [], 0

    def add(self, tokens, node: int, n: int):
        self.held.append((tokens, node, n))
        self.size += len(tokens)
        return self.size >= self.most

    def flush(self, order: int):
        import numpy as np
        import pyarrow as pa

        held, self.held, self.size = self.held, [], 0
        if not held:
            return
        lengths = [len(t) for t, _, _ in held]
        tokens = np.concatenate([t for t, _, _ in held])
        nodes = np.repeat(np.asarray([x for _, x, _ in held], np.int64), lengths)
        sizes = np.repeat(np.asarray([x for _, _, x in held], np.int32), lengths)
        # the low bits are even whatever prefix the tokens were taken from
        part = (tokens % np.uint64(self.parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[by], np.arange(self.parts + 1))
        some = np.flatnonzero(np.diff(bounds))
        cut = lambda x: pa.array([x[by[bounds[p] : bounds[p + 1]]].tobytes() for p in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([order] * len(some), pa.int32()), pa.array(some, pa.int32()), cut(tokens), cut(nodes), cut(sizes)], names=["order", "part", "tokens", "nodes", "sizes"])


PACKED = "order int, part int, tokens binary, nodes binary, sizes binary"


def _unpacked(table):
    """Distinct (token, node) postings of a part, sorted by token and then node, with the nodes' set sizes."""
    import numpy as np

    joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    tokens, nodes, sizes = joined("tokens", np.uint64), joined("nodes", np.int64), joined("sizes", np.int32)
    by = np.lexsort((nodes, tokens))
    tokens, nodes, sizes = tokens[by], nodes[by], sizes[by]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes, sizes = tokens[new], nodes[new], sizes[new]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    return tokens, nodes, sizes, starts, np.diff(np.append(starts, len(tokens)))


def shared_counts(rows: DataFrame, frequent, parts: int) -> DataFrame:
    """node, shared: how many tokens of its first prefix, besides frequent ones, other nodes' prefixes hold too."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def pack(batches):
        packer = _Packer(parts)
        for _, sets in _sets(batches):
            for s in sets:
                if len(s):
                    first = prefix(s, sent.value, 0)
                    if packer.add(first[~_is_in(sent.value, first)], node_of(s), len(s)):
                        yield from packer.flush(0)
        yield from packer.flush(0)

    def count(table):
        import numpy as np
        import pyarrow as pa

        _, nodes, _, starts, runs = _unpacked(table)
        found, times = np.unique(nodes[np.repeat(runs > 1, runs)], return_counts=True)
        bucket = found.view(np.uint64) % np.uint64(parts)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(parts + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        cut = lambda x: pa.array([x[by[cuts[p] : cuts[p + 1]]].tobytes() for p in some], pa.binary())
        return pa.table({"bucket": pa.array(some, pa.int32()), "nodes": cut(found), "times": cut(times.astype(np.int32))})

    def add(table):
        import numpy as np
        import pyarrow as pa

        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        nodes, at = np.unique(joined("nodes", np.int64), return_inverse=True)
        return pa.table({"node": nodes, "shared": np.bincount(at, joined("times", np.int32), len(nodes)).astype(np.int64)})

    partial = rows.mapInArrow(tidy(pack), PACKED).select("part", "tokens", "nodes", "sizes").repartition(parts, "part").groupBy("part").applyInArrow(tidy_group(count), "bucket int, nodes binary, times binary")
    return partial.repartition(parts, "bucket").groupBy("bucket").applyInArrow(tidy_group(add), "node long, shared long")


def candidate_edges(sets: DataFrame, frequent, parts: int) -> DataFrame:
    """Edges (a, b) that connect every linking pair, from the prefix filters of both orders."""
    sent = sets.sparkSession.sparkContext.broadcast(frequent)

    def pack(batches):
        import numpy as np

        for batch in batches:
            held = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            for order in (0, 1):
                packer = _Packer(parts)
                for node, s in zip(batch.column(0).to_pylist(), held, strict=True):
                    if packer.add(prefix(s, sent.value, order), node, len(s)):
                        yield from packer.flush(order)
                yield from packer.flush(order)

    def pairs(key, table):
        import numpy as np
        import pyarrow as pa

        order = int(key[0].as_py())
        tokens, nodes, sizes, starts, runs = _unpacked(table)
        kinds, first, which = np.unique(nodes, return_index=True, return_inverse=True)
        size_of, keys, times = sizes[first], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for m in np.unique(runs[(runs > 1) & (runs <= ALL_PAIRS)]):
            i, j = np.triu_indices(m, 1)
            of_run = starts[runs == m]
            step = max(1, PAIRS // len(i))
            for k in range(0, len(of_run), step):
                at = of_run[k : k + step, None]
                a, b = which[(at + i).ravel()], which[(at + j).ravel()]
                near = 4 * np.minimum(size_of[a], size_of[b]) >= 3 * np.maximum(size_of[a], size_of[b])
                keys, into = np.unique(np.concatenate([keys, a[near] * len(kinds) + b[near]]), return_inverse=True)
                times = np.bincount(into, np.concatenate([times, np.ones(int(near.sum()), np.int64)]), len(keys)).astype(np.int64)
        a, b = keys // max(1, len(kinds)), keys % max(1, len(kinds))
        tied = np.repeat(runs > ALL_PAIRS, runs)
        # a hub is named by its token, apart from nodes but for a 64-bit collision
        hub, ray = (tokens[tied] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), nodes[tied]
        zeros, ones = np.zeros(len(hub), np.int64), np.ones(len(hub), np.int64)
        columns = {
            "a": np.concatenate([kinds[a], hub]), "b": np.concatenate([kinds[b], ray]), "n_a": np.concatenate([size_of[a], zeros]), "n_b": np.concatenate([size_of[b], zeros]),
            "first": np.concatenate([times * (order == 0), ones * (order == 0)]), "second": np.concatenate([times * (order == 1), ones * (order == 1)]), "tie": np.concatenate([np.zeros(len(a)), ones]),
        }
        return pa.table({k: pa.array(v.astype(np.int64 if k in "ab" else np.int32)) for k, v in columns.items()})

    kind = "a long, b long, n_a int, n_b int, first int, second int, tie int"
    found = sets.select("node", "tokens").mapInArrow(tidy(pack), PACKED).repartition(2 * parts, "order", "part").groupBy("order", "part").applyInArrow(tidy_pair(pairs), kind)
    found = shared_table(found.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("n_a", "n_b", "tie")], F.sum("first").alias("first"), F.sum("second").alias("second")), "met")
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * 3 / 7)
    least = F.least(*[F.floor(F.col(n) * 5 / 16) + 1 - F.col(n) + overlap for n in ("n_a", "n_b")])
    paired = found.where((F.col("tie") == 0) & (F.col("first") >= least) & (F.col("second") >= least)).select("a", "b")
    ties = found.where("tie = 1")
    if ties.isEmpty():
        return paired
    # a partner under one order is one under the other: who meets nobody there has no partner at all
    met = found.select(F.explode(F.when(F.col("tie") == 1, F.array("b")).otherwise(F.array("a", "b"))).alias("met"), "first", "second")
    met = met.groupBy("met").agg(F.max("first").alias("any_first"), F.max("second").alias("any_second")).where("any_first > 0 AND any_second > 0").select("met")
    return paired.unionByName(ties.join(met, F.col("b") == F.col("met"), "left_semi").select("a", "b"))


def _links(nodes, sets, left, right):
    """Linking pairs between two index lists of sets (or within one, if they are the same list), by counting shared tokens through an index of some of the right ones at a time."""
    import numpy as np

    same, out = left is right, []
    for p, q in row_slices([len(sets[k]) for k in right], COMPARED):
        some = right[p:q]
        lengths = np.asarray([len(sets[k]) for k in some])
        kinds, flat = np.unique(np.concatenate([sets[k] for k in some]), return_inverse=True)
        starts = np.cumsum(lengths) - lengths
        for i, k in enumerate(left[:q] if same else left):
            begin, own = max(0, i + 1 - p) if same else 0, len(sets[k])
            if begin >= len(some) or not ((4 * lengths[begin:] >= 3 * own) & (3 * lengths[begin:] <= 4 * own)).any():
                continue
            at = np.minimum(np.searchsorted(kinds, sets[k]), len(kinds) - 1)
            mark = np.zeros(len(kinds), bool)
            mark[at[kinds[at] == sets[k]]] = True
            shared = np.add.reduceat(mark[flat[starts[begin] :]].astype(np.int32), starts[begin:] - starts[begin])
            out += [(nodes[k], nodes[some[j]]) for j in np.flatnonzero(100 * shared >= 75 * (own + lengths[begin:] - shared)) + begin]
    return out


def connecting_links(nodes, sets, other_nodes=None, other_sets=None):
    """Pairs of nodes that connect what links between two lists of packed sets (or within the first), every pair of near enough sizes tested."""
    import numpy as np

    held = [np.frombuffer(x, np.uint64) for x in [*sets, *(other_sets or ())]]
    names = [*nodes, *(other_nodes or ())]
    left = list(range(len(nodes)))
    links = [(a, b) for a, b in _links(names, held, left, left if other_nodes is None else list(range(len(nodes), len(names)))) if a != b]
    if not links:
        return []
    found, least = labels(*np.asarray(links, np.int64).T)
    return [(int(a), int(b)) for a, b in zip(found, least, strict=True) if a != b]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id reachable by links, its own included), linked (whether it links with another row).

    Words are lower-cased (A-Z) and separated by space or tab to carriage
    return. Null texts and texts without words have an empty set and link
    with nothing; texts of one to four words are one shingle. Rows with equal
    sets link. A null id is no least id: its row's component_id is the least
    known id of its component, or null. Empty input: no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    frequent = frequent_tokens(rows)
    owned = shared_table(document_nodes(rows, frequent), "nodes")
    size = owned.agg(F.sum("n")).head()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_of = lambda postings: max(least, -(-int(postings) * 20 // PART_BYTES))
    counts = shared_counts(rows, frequent, parts_of(size * 5 / 16))
    nodes = shared_table(owned.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.max("needed").alias("needed"), (F.count(F.lit(1)) > 1).alias("copied")), "node-ids")
    able = nodes.join(counts, "node", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("needed"))
    able = shared_table(able.select("node", F.col("least").alias("able_id"), "n"), "candidates")
    count, total = able.agg(F.count(F.lit(1)), F.sum("n")).head()
    ids = able.select("able_id")
    chosen = rows.join(F.broadcast(ids) if count <= IDS_BROADCAST else ids, F.col("id").eqNullSafe(F.col("able_id")), "left_semi")

    def whole(batches):
        import pyarrow as pa

        for _, sets in _sets(batches):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    sets = shared_table(chosen.mapInArrow(tidy(whole), "node long, tokens binary").dropDuplicates(["node"]), "sets")
    families = shared_table(components(candidate_edges(sets, frequent, parts_of((total or 0) * 5 / 16)), "families"), "families")
    tasks = max(least, -(-int(total or 0) * 8 // PART_BYTES))
    items = sets.select("node", F.floor(F.log(F.octet_length("tokens") / 8.0) / F.log(F.lit(BAND))).cast("int").alias("band"), F.col("tokens").alias("payload"))
    parts = shared_table(family_components(items, families, connecting_links, tasks, "sets"), "classes")
    named = parts.join(nodes, "node")
    names = shared_table(named.groupBy(F.col("component").alias("of_component")).agg(F.min("least").alias("component_id")), "class-ids")
    of_node = parts.join(small(names), F.col("component") == F.col("of_component")).select(F.col("node").alias("linked"), F.col("component_id").alias("linked_id"))
    of_node = nodes.join(of_node, F.col("node") == F.col("linked"), "left").select(F.col("node").alias("of"), F.coalesce("linked_id", "least").alias("component_id"), (F.col("copied") | F.col("linked").isNotNull()).alias("is_linked"))
    of_node = shared_table(of_node, "component-ids")
    return owned.join(of_node, F.col("node") == F.col("of"), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("is_linked", F.lit(False)).alias("linked"))
