"""The queries of this subpackage: (spark, folder of tables) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, collocations, decontaminate, language, licenses, neardup, packing, passages, secrets, sstable, topk, toxicity
from ._shared import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.find(table(spark, folder, "documents"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.remove(table(spark, folder, "documents"))


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = topk.quantised(table(spark, folder, "embeddings"))
    return topk.search(rows, rows.where("vec_id % 20 = 0"), k=20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan(documents, secrets.fitted(spark, documents))
    return found.select("doc_id", F.posexplode("findings").alias("place", "finding")).select("doc_id", "place", "finding.*")


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sstable.read(sstable.write(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = toxicity.sampled(table(spark, folder, "labels").where(~held_out()), "toxic")
    machine = toxicity.fit(documents.where(~held_out()).select("doc_id", "text").join(F.broadcast(labels), "doc_id"))
    return toxicity.score(documents.withColumn("held_out", held_out()), machine, keep=("doc_id", "held_out"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """A document's path is source / its thousand / its id: the tables have no paths of their own."""
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.concat(F.col("doc_id"), F.lit(".txt")))
    return licenses.scan(table(spark, folder, "documents").withColumn("path", path), "path")


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    profiles = language.fit_profiles(documents.where(~held_out()))
    return language.predict(documents.withColumn("held_out", held_out()), profiles, keep=("doc_id", "held_out"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    phrases = written(collocations.frequent_phrases(table(spark, folder, "documents")), "phrases")
    return collocations.top(collocations.scored(phrases)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, range(1, 5) sizes(k) WHERE len(w) >= k
  ) GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM candidates, range(1, 4) places(k) WHERE k < size
), best AS (
  SELECT c.lang, c.phrase, c.a, min(struct_pack(score := (CAST(2000000 AS HUGEINT) * c.a) // (h.f + t.f), k := k, l := h.f, r := t.f)) AS cut
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail GROUP BY ALL
), within AS (
  SELECT lang, phrase, max(f) AS longest FROM (
    SELECT lang, f, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM candidates, range(2, 4) parts(m) WHERE m < size
  ) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY cut.score DESC, a DESC, b.phrase) AS rank, b.phrase, a, cut.l AS l, cut.r AS r, n, CAST(cut.score AS BIGINT) AS score
FROM best b JOIN totals USING (lang) LEFT JOIN within i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE NOT coalesce(CAST(100 AS HUGEINT) * longest >= CAST(80 AS HUGEINT) * a, FALSE) QUALIFY rank <= 2000
"""


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def queries() -> dict:
    found = (
        op1_near_dedup, op2_substring_dedup, op3_topk, op4_secrets, op5_bpe, op6_token_shards, op7_toxicity, op8_decontaminate, op9_licenses, op10_language,
        op11_alignment, op12_collocations, op13_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op12_collocations": OP12_SQL}
