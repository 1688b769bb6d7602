import random

import corpus_pipeline as pipeline
import pytest

from quire.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_decisions_take_effect(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    text = lambda seed, n=60: " ".join("".join(random.Random(seed * 1000 + i).choice("abcdefghilmnoprstu") for _ in range(6)) for i in range(n))
    good = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(1, 30)]
    copy = (100, text(5).upper(), "en", "s1", 0)
    near = (101, text(6).replace(text(6).split()[30], "changed", 1), "en", "s1", 0)
    bad = [(200, "short", "en", "s0", 0), (201, None, None, None, None), (202, "1 2 3 4 5 6 7 8 9 10 11 12", None, "s0", 0), (203, "w " * 500, "en", "s0", 0)]
    spark.createDataFrame([*good, copy, near, *bad], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id for r in docs.collect()})
    assert not kept[0] & {200, 201, 203} and 202 in kept[0]
    assert 202 not in kept[1] and {r[0] for r in good} <= kept[1]
    assert 100 in kept[2] and 5 not in kept[2]
    assert len(kept[3] & {6, 101}) == 1
    out = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == kept[3]
    assert langid.UNKNOWN == "und"


def test_near_stage_tells_rows_of_one_id_apart(spark):
    text = lambda seed: " ".join(f"w{seed}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(2)), (2, text(1) + " more"), (3, text(3)), (3, text(3) + " end"), (None, text(2) + " x"), (None, text(4)), (None, None)]
    docs = spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id long, text string, gone long")
    out = pipeline.near_stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    third = [r for r in kept if r[1] == 3]
    assert len(third) == 1 and [r for r in kept if r[1] != 3] == sorted([(False, 1, text(1)), (False, 1, text(2)), (True, 0, text(4)), (True, 0, "")])


def test_empty(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
