"""The registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, exact_dedup, jaccard, langid, linededup, maxent, packing, quality, sharding
from .common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"), "kept")


def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_classes(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "line_no", F.col("class_id").alias("class_doc_id"), "class_line", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.decode_ids(byte_bpe.encode_texts(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.col("text")
    out = sharding.shard_records(docs, F.struct("doc_id", sharding.text_crc32(text)), sharding.text_size(text), shards=16)
    return out.select(
        F.col("record.doc_id").alias("doc_id"), sharding.text_size(F.col("record.text")).alias("size"), sharding.text_crc32(F.col("record.text")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs))
    return found.select(F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "body", "parent_turn", "root_turn", "depth", "position")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_duplicates(documents(spark, sf_dir))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
li AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(li.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN li ON li.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS fails FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(fails / n) AS m, var_pop(fails / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 1e-9 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 10 END AS s FROM m),
bad AS (SELECT source FROM h, s WHERE (m * s + fails) / (s + n) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM f
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = w.doc_id
"""

OP9_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS r, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
l AS (SELECT r, conv_id, turn, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM m),
k AS (SELECT r, conv_id, turn, i, x, regexp_extract(x, '^[ \t]*(?:>[ \t]*)+') AS mark FROM l),
p AS (SELECT r, conv_id, turn, i, CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN -1 ELSE length(regexp_replace(mark, '[^>]', '', 'g')) END AS level, substr(x, length(mark) + 1) AS content FROM k),
g AS (SELECT *, i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS island FROM p),
runs AS (SELECT r, conv_id, turn, level, island, string_agg(content, ' ' ORDER BY i) AS s, string_agg(trim(lower(regexp_replace(content, '[\x20\x09-\x0D]+', ' ', 'g'))), chr(10) ORDER BY i) AS rows FROM g WHERE level >= 0 GROUP BY r, conv_id, turn, level, island),
own AS (SELECT r, conv_id, turn, trim(string_agg(content, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM p WHERE level <= 0 GROUP BY r, conv_id, turn),
said AS (SELECT conv_id, turn, r, s FROM runs WHERE level = 0 UNION ALL SELECT conv_id, turn, r, content FROM p WHERE level = 0 UNION ALL SELECT conv_id, turn, r, body FROM own),
held AS (SELECT conv_id, s, min(turn) AS origin FROM (SELECT conv_id, turn, trim(lower(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'))) AS s FROM said) WHERE s <> '' GROUP BY conv_id, s),
parts AS (SELECT r, conv_id, turn, level, island, 0 AS rank, s FROM runs WHERE level > 0
  UNION ALL SELECT r, conv_id, turn, level, island, 1, unnest(regexp_split_to_array(rows, '\n{2,}')) FROM runs WHERE level > 0
  UNION ALL SELECT r, conv_id, turn, level, island, 2, unnest(string_split(rows, chr(10))) FROM runs WHERE level > 0),
quoted AS (SELECT r, conv_id, turn, level, island, rank, trim(lower(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'))) AS s FROM parts),
found AS (SELECT r, level, island, origin, row_number() OVER (PARTITION BY r, level, island ORDER BY rank, origin DESC) AS nth FROM quoted JOIN held USING (conv_id, s) WHERE origin < turn AND s <> ''),
par AS (SELECT r, origin FROM (SELECT r, origin, row_number() OVER (PARTITION BY r ORDER BY level, origin DESC) AS nth FROM found WHERE nth = 1) WHERE nth = 1),
msg AS (SELECT m.*, par.origin AS parent_turn FROM m LEFT JOIN par ON par.r = m.r),
tree AS (SELECT r, conv_id, turn, turn AS root_turn, 0 AS depth FROM msg WHERE parent_turn IS NULL
  UNION ALL SELECT c.r, c.conv_id, c.turn, t.root_turn, t.depth + 1 FROM msg c JOIN tree t ON c.conv_id = t.conv_id AND c.parent_turn = t.turn)
SELECT msg.conv_id, msg.turn, role, coalesce(body, '') AS body, parent_turn, root_turn, depth::BIGINT AS depth,
  row_number() OVER (PARTITION BY msg.conv_id ORDER BY root_turn, depth, msg.turn) - 1 AS position
FROM msg JOIN tree ON tree.r = msg.r LEFT JOIN own ON own.r = msg.r
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_maxent_scores": op3_maxent_scores,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_chat_quotations": op9_chat_quotations,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_chat_quotations": OP9_SQL, "op10_exact_dedup": OP10_SQL}
