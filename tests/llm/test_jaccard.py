import itertools
import random
import re

import numpy as np
import pytest

from quire.llm import families, graph, jaccard
from quire.llm.graph import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k is None, k or 0, len(sets[i]), least.get(find(i)) or 0) for i, (k, _) in enumerate(rows))


def near_copies(draw, count):
    words = [f"w{draw.randrange(400)}" for _ in range(60)]
    for _ in range(count):
        own = list(words)
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        yield " ".join(own)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(families, "BLOCK", 16)  # so that a group takes several blocks and bands
    monkeypatch.setattr(jaccard, "ALL_PAIRS", 8)
    draw = random.Random(7)
    texts = [t for n in (2, 3, 5, 90) for t in near_copies(draw, n)]
    shared = " ".join(f"p{i}" for i in range(30))
    texts += [" ".join([shared, *(f"q{draw.randrange(10**6)}" for _ in range(draw.randrange(20, 200)))]) for _ in range(60)]
    base = [f"z{i}" for i in range(300)]
    texts += [" ".join(base[:k]) for k in range(20, 300, 4)]  # a chain over many bands
    texts += ["A b C d", "a B c D", "a b c", "one two three four five", "ONE two  three\tfour\nfive", "", None, " \n\t ", texts[0], "é É " * 300, "é É " * 299]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, "a b c"), (3, "a b c")]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 1, "n") for k, t in rows], "doc_id long, text string, node int, component string").repartition(5)
    out = sorted((r.id is None, r.id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.similar_documents(docs).collect())
    assert out == brute(rows)


def test_prefixes_of_small_sets_share_enough():
    for n, m in itertools.product(range(1, 13), repeat=2):
        for o in range(-(-3 * (n + m) // 7), min(n, m) + 1):
            tokens = np.arange(n + m - o, dtype=np.uint64)
            for own in itertools.combinations(range(len(tokens)), n - o):
                rest = [k for k in range(len(tokens)) if k not in own]
                for other in itertools.combinations(rest, m - o):
                    x, y = np.delete(tokens, list(other)), np.delete(tokens, list(own))
                    both = np.intersect1d(x[: jaccard.prefix_size(n)], y[: jaccard.prefix_size(m)])
                    assert len(both) >= jaccard.prefix_shared(n), (n, m, o)


def test_prefixes_of_contained_sets_share_enough():
    draw = np.random.default_rng(3)
    for m in range(1, 61):
        for n in range(-(-3 * m // 4), m + 1):
            for _ in range(40):
                y = np.arange(m, dtype=np.uint64)
                x = np.sort(draw.choice(y, n, replace=False))
                for order in (0, 1):
                    both = np.intersect1d(jaccard.prefix(x, np.zeros(0, np.uint64), order), jaccard.prefix(y, np.zeros(0, np.uint64), order))
                    assert len(both) >= max(jaccard.prefix_shared(n), jaccard.prefix_shared(m)), (n, m)


def test_large_family_of_several_classes(spark, monkeypatch):
    # one family, made by hubs of shared words: a large class, a chain at its edge, and texts that link with nothing
    monkeypatch.setattr(families, "BLOCK", 8)
    monkeypatch.setattr(families, "LEADERS", 2)
    monkeypatch.setattr(jaccard, "ALL_PAIRS", 4)
    draw = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"e{draw.randrange(10**6)}" for _ in range(4)]) for k in [120] * 40 + list(range(60, 120, 2))]
    texts += [" ".join(base[:70] + [f"u{draw.randrange(10**6)}" for _ in range(22)]) for _ in range(30)]
    rows = list(enumerate(texts))
    out = sorted((r.id is None, r.id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert out == brute(rows)


def test_two_words_more(spark):
    # 7 shingles against 9: a few in a hundred pairs share but one token of their prefixes
    texts = [[f"t{i}w{k}" for k in range(13)] for i in range(300)]
    rows = [(2 * i + j, " ".join(t if j else (t[2:] if i % 2 else t[:-2]))) for i, t in enumerate(texts) for j in (0, 1)]
    out = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in out} == {k: k - k % 2 for k, _ in rows}


def test_empty(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("finish", [10**6, 0])
def test_components_of_chains(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH", finish)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000)] + [(500 + 2 * i, 501 + 2 * i) for i in range(20)] + [(700, x) for x in range(701, 760)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(out[i] == 0 for i in range(201)) and out[501] == 500 and out[759] == 700 and out[700] == 700 and 1000 not in out
