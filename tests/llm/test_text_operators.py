import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, language, queries, sstable, topk


def thue_morse(letters):
    """Two different words of as many letters whose polynomial hashes modulo 2 ** 64 are equal for any base."""
    bits = [bin(k).count("1") % 2 for k in range(letters)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def texts(folder):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())


# --- byte-level BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, data, tiktoken_encoding):
    given = texts(data)
    got = queries.op5_bpe(spark, data).collect()
    assert len(got) == len(given)
    for r in got:
        ids = tiktoken_encoding.encode_ordinary(given[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((given[r.doc_id] or "").encode()).hexdigest()


def test_bpe_odd(odd, empty, tiktoken_encoding):
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(odd, *args, keep=("doc_id", "text"))
    assert coded.count() == odd.count()
    for r in coded.collect():
        assert r.ids == tiktoken_encoding.encode_ordinary(r.text or "")
    for r in bpe.decode(coded, *args, keep=("text",)).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip(empty, *args).count() == 0


def test_rank_queue_with_random_merges(tiktoken_encoding):
    import random

    own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(" \n\t  aAbteé'sl1٣!?#́漢😀") for _ in range(draw.randint(0, 40)))
        assert own.encode(text) == tiktoken_encoding.encode_ordinary(text), repr(text)
    for text in ("a" * 5000, "ab" * 3000, "aaab" * 999 + "aa"):
        assert own.encode(text) == tiktoken_encoding.encode_ordinary(text)


# --- token shards -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected_shards(pairs, tokenizer):
    start, out = 0, []
    for doc, text in pairs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_shards_equal_library(spark, data, word_tokenizer):
    want = expected_shards(sorted(texts(data).items()), word_tokenizer)
    assert sorted(map(tuple, queries.op6_token_shards(spark, data).collect())) == want


def test_shards_odd(odd, empty, word_tokenizer):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    manifest = sstable.write(odd, path, 1)
    got = sorted(map(tuple, sstable.read(manifest).collect()), key=lambda r: r[1])
    assert got == expected_shards(rows, word_tokenizer)
    assert [len(x) for x in sstable.lookup(manifest, 9)] and sstable.lookup(manifest, 12345) == []
    assert sstable.lookup(manifest, 4) == [word_tokenizer.encode("one", add_special_tokens=False).ids + [1]]
    assert sstable.read(sstable.write(empty, path, 1)).count() == 0


def test_texts_with_added_tokens(word_tokenizer):
    codec = sstable.WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    given = [
        "<|endoftext|>", "hello <|endoftext|> world", "in<|startoftext|>side a<|endoftext|>", "<|endoftext|><|endoftext|> twice", "<|EndOfText|> other case", "<| endoftext |>", "x<|endoftext|>\ny", "a|b <|b|> it's",
        "\u3000wide\u2028line\x0bvertical\x1cgap\u00a0", "E\u0301 \u0301 e\u0301x ﬁ İ ẞ", "", " ", None, "w" * 3000, "1234 五六 \u0661\u0662", "Word, word. WORD; \u00c9t\u00e9. \u00c9T\u00c9, don'T. x., .. a.. 1, 1. \u00d7. \u00b5, \u00df. \u00aa. \u00ba,",
    ]
    for _ in range(3):  # new, seen once, remembered
        for text, raw in zip(given, codec.encode_all(given)):
            assert [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)] == word_tokenizer.encode(text or "", add_special_tokens=False).ids, text


# --- top-k ------------------------------------------------------------------------------------


def test_topk_equals_sql(spark, data):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
        want = sorted(con.sql(queries.OP3_SQL).fetchall())
    assert sorted(map(tuple, queries.op3_topk(spark, data).collect())) == want


def test_topk_odd(spark):
    schema = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, -0.5], "z"), (1, [1.0, 0.0], "z"), (2, [1.0, 0.0], None), (2, [1.0, 0.0], None), (3, None, None), (4, [float("nan"), 1.0], None), (5, [None, 1.0], None), (6, [float("inf")], None), (7, [], None), (None, [1.0], None), (20, [2.0], None)]
    given = topk.quantised(spark.createDataFrame(rows, schema))
    got = [tuple(r) for r in topk.search(given, given.where("vec_id % 20 = 0"), k=3, row_block=2, query_block=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 8192), (0, 2, 1, 4096), (0, 3, 2, 4096), (20, 1, 0, 8192), (20, 2, 1, 8192), (20, 3, 2, 8192)]
    huge = topk.quantised(spark.createDataFrame([(0, [2.0**55]), (1, [2.0**3])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="63 bits"):
        topk.search(huge, huge).collect()
    none = given.where("vec_id < 0")
    assert topk.search(none, none).count() == 0
    assert topk.search(given, none).count() == 0


def test_topk_blocks_are_bounded():
    """Longer vectors make blocks of fewer rows, and no pair of blocks has more products than the bound."""
    for width in (1, 64, 768, 1024, 20_000):
        n_rows, n_queries = topk.blocks(10**9, 10**7, width)
        rows, asked = -(-(10**9) // n_rows), -(-(10**7) // n_queries)
        assert rows * width <= topk.BLOCK_COMPONENTS and asked * width <= topk.BLOCK_COMPONENTS and rows * asked * width <= topk.BLOCK_PRODUCTS
    assert topk.blocks(0, 0, 0) == (1, 1)


def test_topk_of_uneven_vectors_equals_brute_force(spark, monkeypatch):
    """Vectors of several lengths, repeated rows and ties, in many small blocks."""
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", 64)
    monkeypatch.setattr(topk, "BLOCK_PRODUCTS", 512)
    rng = np.random.default_rng(5)
    rows = [(i % 90, [float(x) for x in rng.integers(-2, 3, int(rng.integers(0, 9))) / 2]) for i in range(100)]
    given = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = [(r.vec_id, r.weights) for r in given.collect()]
    want = []
    for q in {v for v, _ in held if v % 20 == 0}:
        w = min(x for v, x in held if v == q)
        scored = sorted((-sum(a * b for a, b in zip(w, x)), v) for v, x in held if v != q)[:7]
        want += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scored)]
    assert sorted(map(tuple, topk.search(given, given.where("vec_id % 20 = 0"), k=7).collect())) == sorted(want)


# --- benchmark decontamination ----------------------------------------------------------------

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(documents, items, window=10):
    wanted = {}
    for item, text in items:
        w = lowered(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wanted.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else item)
    sizes = {len(w) for w in wanted}
    out = []
    for doc, text in documents:
        w = lowered(text)
        hit, found = [False] * len(w), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wanted:
                    hit[k : k + size] = [True] * size
                    found |= wanted[tuple(w[k : k + size])]
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), sum(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def test_decontaminate_equals_brute_force(spark, data):
    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()
    got = sorted(map(tuple, queries.op8_decontaminate(spark, data).collect()), key=str)
    assert got == brute(texts(data).items(), items)
    assert sum(r[-1] for r in got) > 0


@pytest.mark.parametrize("slice_words", [2_000_000, 8])
def test_decontaminate_odd(spark, odd, empty, slice_words):
    items = [("a", "one"), ("b", "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11"), ("c", None), ("d", ""), ("e", "b's 12 345"), ("e", "no id here"), ("f", "no id here"), (None, "other text same id"), ("g", "Z z z z z z z z z z z z")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = odd.select("doc_id", "text").union(spark.createDataFrame([(50, "z " * 40 + "y one"), (51, "one")], "doc_id long, text string"))
    got = decontaminate.digest(decontaminate.find(rows, bench, slice_words=slice_words, shard_words=5000))
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in rows.collect()], items)
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [1, 2, 3, 8, 9]
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontaminate_spans(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"q{k}" for k in range(14)) + " y")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "u " + " ".join(f"q{k}" for k in range(14)))], "item_id long, text string")
    (row,) = decontaminate.find(docs, bench).collect()
    assert [tuple(s) for s in row.spans] == [(1, 14, "7", 1)] and row.n_hit == 14


def test_decontaminate_made_words(spark):
    """Long words that polynomial hashes confuse, long repeats, and an item of 20,000 words."""
    x, y = thue_morse(1024)
    long = " ".join(f"v{k % 700}" for k in range(20_000))
    items = [("t", f"a b c d {x} e f g h i"), ("l", long), ("r", "z " * 30), ("s", "q " * 9)]
    docs = [(1, f"a b c d {y} e f g h i"), (2, f"0 a b c d {x} e f g h i 0"), (3, long[100:]), (4, "z " * 500 + "y " + "q " * 20), (5, long.replace("v350", "v"))]
    got = decontaminate.digest(decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


# --- language ---------------------------------------------------------------------------------


def test_language_accuracy(spark, data):
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = queries.op10_language(spark, data).join(truth, "doc_id")
    assert got.count() == truth.count()
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.95 and 0 <= held[1] <= held[2] <= 1


def test_language_equals_brute_force(spark, data):
    """Profiles and predictions by plain counting on some hundred texts."""
    from collections import Counter

    def grams(text):
        words, out = re.findall(r"[^\W\d_]+", (text or "").lower()), Counter()
        joined = "\1" + "\1".join(words) + "\1"
        for n in (1, 2, 3):
            for k in range(len(joined) - n + 1):
                g = joined[k : k + n]
                if g.strip("\1") and (n < 3 or g[1] != "\1"):
                    out[g] += 1
        return out

    def code(g):
        n = 0
        for c in g:
            n = n << 21 | ord(c)
        return n

    def top(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: language.PROFILE_SIZE]]

    rows = [(d, t, name) for d, t, name in duckdb.sql(f"SELECT doc_id, text, lang FROM '{data}/documents.parquet' ORDER BY doc_id LIMIT 160").fetchall() if t is None or t.isascii() or all(c.isalpha() or ord(c) < 128 for c in t)]
    counts = {}
    for _, t, name in rows[::2]:
        counts.setdefault(name, Counter()).update(grams(t))
    want_profiles = {name: top(c) for name, c in counts.items() if name}
    df = spark.createDataFrame(rows[::2], "doc_id long, text string, lang string")
    profiles = language.fit_profiles(df)
    assert profiles == {name: [code(g) for g in found] for name, found in sorted(want_profiles.items())}
    want = {}
    for d, t, _ in rows:
        own = top(grams(t))
        best = min(((sum(abs(p.index(g) - k) if g in p else language.PROFILE_SIZE for k, g in enumerate(own)), name) for name, p in want_profiles.items()), default=None) if own else None
        want[d] = (best[1], pytest.approx(1 - best[0] / (language.PROFILE_SIZE * len(own)))) if best else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), profiles).collect()}
    assert got == want


def test_language_odd(spark, odd, empty):
    train = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 2), (3, None, "en", 3), (4, "zzz", None, 4), (5, "12", "en", 5)], "doc_id long, text string, lang string, gram long")
    profiles = language.fit_profiles(train)
    assert sorted(profiles) == ["de", "en"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(odd, profiles).collect()]
    assert len(got) == odd.count() and all(0 <= s <= 1 for _, _, s in got)
    assert {d for d, name, _ in got if name == "und"} == {1, 2, 3}
    assert language.predict(empty, profiles).count() == 0
    assert language.fit_profiles(train.where("lang = 'xx'")) == {}
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}
    tie = language.predict(spark.createDataFrame([(1, "qq")], "doc_id long, text string"), {"b": [1, 2], "a": [1, 2]}).first()
    assert tie.lang_pred == "a"
