import math
import random

import duckdb

from quarry.llm import components, neardup, queries

from .test_text_operators import thue_morse


def brute(documents):
    """component by doc_id of documents [(doc_id, text)] with different ids."""
    sets = {}
    for doc, text in documents:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = {}
    for doc, found in sets.items():
        for s in found:
            where.setdefault(s, []).append(doc)
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for doc, found in sets.items():
        shared = {}
        for s in found:
            for other in where[s]:
                if other < doc:
                    shared[other] = shared.get(other, 0) + 1
        for other, both in shared.items():
            if 100 * both >= 75 * (len(found) + len(sets[other]) - both):
                a, b = sorted((top(doc), top(other)))
                parent[b] = a
    return {d: (len(sets[d]), top(d)) for d in sets}


def check(df, documents):
    want = brute(documents)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_equals_brute_force(spark, data):
    given = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    check(queries.op1_near_dedup(spark, data), given)


def test_groups_of_near_copies(spark, monkeypatch):
    """A chain and a large group whose members are linked only in part, over several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    draw = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(60)] = f"x{draw.randrange(10**6)}"
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000 + k, " ".join(f"c{n}" for n in range(3 * k, 3 * k + 60))) for k in range(20)]
    rows += [(3000 + k, "short text") for k in range(5)] + [(4000, None), (4001, ""), (4002, "One two THREE"), (4003, "one TWO three")]
    check(neardup.find(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_odd(spark, odd, empty):
    rows = neardup.find(odd)
    assert rows.count() == odd.count()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows.collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 1, None, True)} <= got
    assert neardup.find(empty).count() == 0
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    copies = spark.createDataFrame([(1, "a b c d e f", 5), (2, "A b c d e f", 6), (3, "zz", 7)], "doc_id long, text string, kept int")
    assert sorted(r.doc_id for r in neardup.deduplicate(copies).collect()) == [1, 3]


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 950)] + [(7, 7), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    # the smallest node of a component is named by the others
    assert {x: top(x) for x in parent if top(x) != x} == {x: c for x, c in got.items() if x != c}
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none).count() == 0


def test_few_pairs_at_the_limit_are_dropped():
    """A pair at 0.75 is lost by bands and signature test together with probability below 1e-4."""
    n, p = neardup.BANDS * neardup.ROWS, neardup.SIMILARITY / 100
    dropped = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1) if k / n < neardup.AGREEMENT)
    assert dropped < 1e-5 and dropped + (1 - p**neardup.ROWS) ** neardup.BANDS < 1e-4


def test_words_that_polynomial_hashes_confuse(spark):
    """Two long words with equal polynomial hashes modulo 2 ** 64 make different shingles."""
    rows = []
    for at, letters in enumerate((1024, 4096)):
        x, y = thue_morse(letters)
        rows += [(10 * at + 1, f"one {x} two three four"), (10 * at + 2, f"one {y} two three four"), (10 * at + 3, f"one {x} two THREE four")]
    check(neardup.find(spark.createDataFrame(rows, "doc_id long, text string")), rows)
