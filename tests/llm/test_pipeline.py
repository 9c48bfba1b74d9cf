import hashlib
import re

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, secrets

from .test_neardup import brute as near_copies
from .test_text_operators import brute as contaminated


def read(folder, name):
    return duckdb.sql(f"SELECT * FROM '{folder}/{name}.parquet'").fetchall()


def test_run_equals_brute_force(spark, data):
    """The rows of run() from the stages done plainly, one document at a time."""
    import tiktoken

    docs = {r[0]: r[1] for r in read(data, "documents")}
    docs = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    component = near_copies(docs.items())
    docs = {d: t for d, t in docs.items() if component[d][1] == d}
    hit = {r[0] for r in contaminated(docs.items(), read(data, "benchmark")) if r[-1]}
    docs = {d: re.sub('(?i)(token = ")[0-9a-f]{40}(")', rf"\1{secrets.MARK}\2", t) for d, t in docs.items() if d not in hit}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in docs.items():
        ids = encoding.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, data).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_survive_odd_tables(spark, data, odd, empty):
    for given in (odd, empty):
        docs = given.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
        names = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, data)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == names
        assert docs.count() <= given.count()


def test_kept_documents_share_no_rows_lost(spark, data):
    """Language and secret stages keep every clean document."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert corpus_pipeline.language_id(spark, docs, data).count() == docs.count()
    assert corpus_pipeline.secret_scan(spark, docs, data).count() == docs.count()
    changed = corpus_pipeline.secret_scan(spark, docs, data).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").where("text <> was")
    assert changed.where("lower(was) not like '%token%'").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_are_named(k):
    name, stage = corpus_pipeline.STAGES[k]
    assert name and callable(stage)
