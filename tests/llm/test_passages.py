import hashlib
import random
from collections import Counter

import duckdb

from quarry.llm import passages, queries

from .test_text_operators import thue_morse


def brute(rows, window=35):
    split = [(d, (t or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")) for d, t in rows]
    split = [(d, [w for w in words if w]) for d, words in split]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark, data):
    given = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    got = rows_of(queries.op2_substring_dedup(spark, data))
    assert got == brute(given) and sum(r[2] for r in got) > 0


def test_made_cases(spark):
    draw = random.Random(4)
    own = lambda n: [f"u{draw.randrange(10**9)}" for _ in range(n)]
    long, exact, short = own(120), own(35), own(34)
    rows = [
        own(50) + long + own(40), own(10) + long[30:100] + own(60), exact + own(30), own(30) + exact, own(20) + short + own(20), short + own(50),
        own(5) + ["z"] * 90 + own(5), ["z"] * 36, ["y"] * 35, own(40) * 2, own(20) * 2, long[:60] + own(3) + long[60:], own(36), [], own(34),
    ]
    rows = [(k, " \n".join(w)) for k, w in enumerate(rows)]
    rows += [rows[12], (99, None), (98, ""), (97, "the same doc"), (97, rows[12][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(passages.remove(df)) == brute(rows)
    assert rows_of(passages.remove(df, shard_chars=2000)) == brute(rows)


def test_common_anchors_and_long_words(spark, monkeypatch):
    """A line in many passages, many copies, and words that polynomial hashes confuse; with anchors told apart by windows."""
    x, y = thue_morse(4096)
    draw = random.Random(5)
    own = lambda n: [f"u{draw.randrange(10**9)}" for _ in range(n)]
    line, para, copy = own(22), own(300), own(60)
    pairs = [own(20) + line + own(20) for _ in range(30)]
    rows = [own(10) + p + own(10) for p in pairs for _ in range(2)] + [own(5) + line + own(30) for _ in range(20)] + [copy] * 40 + [own(4) + para + own(4), para[:150] + own(3) + para[120:], para[100:140]]
    rows += [own(17) + [x] + copy[:17], copy[:17] + [x] + own(17), copy[:17] + [y] + copy[17:34], copy[:17] + [x] + copy[17:34]]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(passages.remove(df)) == brute(rows)
    monkeypatch.setattr(passages, "COMMON", 4)
    monkeypatch.setattr(passages, "PIECE", 7)
    assert rows_of(passages.remove(df, shard_chars=3000)) == brute(rows)
    monkeypatch.setattr(passages, "HOT", 100)
    assert rows_of(passages.remove(df, shard_chars=3000)) == brute(rows)


def test_odd(spark, odd, empty):
    assert rows_of(passages.remove(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert passages.remove(empty).count() == 0
