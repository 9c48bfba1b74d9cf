"""Cross-tokenizer alignment, phrase collocations and packing."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import alignment, collocations, packing, queries

A, B, W = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


# --- cross-tokenizer alignment ----------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    table = {c: b for b, c in _printable().items()}
    a_bytes = {k: bytes(table[c] for c in t) for t, k in a.get_vocab().items() if all(c in table for c in t)}
    assert decoders.ByteLevel().decode(["Ġthe"]) == " the" and a_bytes[a.token_to_id("Ġthe")] == b" the"
    return a, sentencepiece.SentencePieceProcessor(model_file=B), a_bytes


def _printable():
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def aligned_by_force(texts, libraries):
    """Rows of op11 by comparing all tokens of a text with all others."""
    a, b, a_bytes = libraries
    held = []
    for text in texts:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba = [a_bytes[k] for k in ia]
        bb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        raw = b" " + (text or "").encode()
        if not text or b"".join(ba) != raw or b"".join(bb) != raw:
            held.append(None)
            continue
        sa, sb = spans(ba), spans(bb)
        links = [(x, y) for x, p in zip(ia, sa) for y, q in zip(ib, sb) if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [f"{','.join(str(x) for x, p in zip(ia, sa) if lo < p[1] <= hi)}|{','.join(str(y) for y, q in zip(ib, sb) if lo < q[1] <= hi)}" for lo, hi in zip([0, *cuts], cuts)]
        held.append((ia, ib, groups, links))
    counts = Counter(pair for x in held if x for pair in set(x[3]))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for x in held:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            ia, ib, groups, links = x
            out.append((len(ia), len(ib), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def row_of(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


PLAIN = ["the the cat sat", "the cat", "aaaa aaa aaaaa", "...... ..... ....!!!", "Ünïcode ñandú 漢字 😀́ a'b 12 345", "<|endoftext|> <s> </s> <unk>", "with ▁ in it", "  two   blanks \n\n\t x", "", None, "the the cat sat", "ﬁ½ a"]


def test_alignment_equals_brute_force(spark, libraries):
    rows = spark.createDataFrame(list(enumerate(PLAIN)), "doc_id long, text string")
    got = {r.doc_id: row_of(r) for r in alignment.align(rows, A, B).documents.collect()}
    assert got == dict(enumerate(aligned_by_force(PLAIN, libraries)))


def test_alignment_of_the_table(spark, data, libraries):
    few = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' WHERE length(text) < 700 ORDER BY doc_id").fetchall()
    rows = spark.createDataFrame(few, "doc_id long, text string")
    got = {r.doc_id: row_of(r) for r in alignment.align(rows, A, B).documents.collect()}
    assert got == {d: x for (d, _), x in zip(few, aligned_by_force([t for _, t in few], libraries))}


def test_alignment_without_broadcast_groups(spark, libraries, monkeypatch):
    """The same sums whether groups go by broadcast or by shuffle."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(PLAIN)], "doc_id long, text string")
    monkeypatch.setattr(alignment, "HOT", 3)
    assert {r.doc_id: row_of(r) for r in alignment.align(rows, A, B).documents.collect()} == dict(enumerate(aligned_by_force(PLAIN, libraries)))


def test_alignment_tables(spark, libraries):
    rows = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, None)], "doc_id long, text string")
    found = alignment.align(rows, A, B)
    a, b, _ = libraries
    the = (a.token_to_id("Ġthe"), b.piece_to_id("▁the"))
    assert found.groups.where(F.col("group") == f"{the[0]}|{the[1]}").first().docs == 2
    assert [(r.docs, r.best) for r in found.pairs.where(f"a = {the[0]}").collect()] == [(2, 2)]


def test_alignment_odd(odd, empty, libraries):
    given = [(r.doc_id, r.text) for r in odd.collect()]
    short = [(d, t) for d, t in given if len(t or "") < 1000]
    rows = odd.sparkSession.createDataFrame(short, "doc_id long, text string")
    got = sorted(((r.doc_id, *row_of(r)) for r in alignment.align(rows, A, B).documents.collect()), key=str)
    assert got == sorted(((d, *x) for (d, _), x in zip(short, aligned_by_force([t for _, t in short], libraries))), key=str)
    whole = alignment.align(odd, A, B).documents.collect()
    assert len(whole) == len(given) and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in whole)
    assert alignment.align(empty, A, B).documents.count() == 0


# --- phrase collocations ----------------------------------------------------------------------


def phrases_by_force(rows, least, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for sign in ".,;:!?\n\v\f\r":
            low = low.replace(sign, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[at : at + k])] += 1
    return {key: c for key, c in f.items() if c >= least}, n


def collocations_by_force(rows, least, first):
    f, n = phrases_by_force(rows, least)
    longer = {k: c for k, c in f.items() if len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, words), a in longer.items():
        score, k = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
        if not any(g == lang and len(w) > len(words) and 100 * c >= 80 * a and any(w[at : at + len(words)] == words for at in range(len(w))) for (g, w), c in longer.items()):
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)}


MADE = [("en", f"The big Cat sat, the big cat ran. a{k % 3} b{k % 3} c{k % 2}\nnew\tyork city hall; new york") for k in range(12)] + [(None, "alpha beta gamma delta alpha beta")] * 5 + [("de", "ä Ä ä Ä ä Ä"), ("de", None), ("de", "  ,,  ")]


@pytest.mark.parametrize("bits", [16, 20])
def test_phrases_equal_brute_force(spark, bits):
    rows = spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(MADE)], "doc_id long, text string, lang string").repartition(5)
    want, n = phrases_by_force(MADE, 4)
    got = collocations.frequent_phrases(rows, least=4, bits=bits).collect()
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in got} == want and len(got) == len(want)
    assert all(r.n == n[r.lang] and r["size"] == len(r.phrase.split(" ")) for r in got)


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    """Were all phrases in few buckets, pruning would keep more, and the counts stay exact."""
    monkeypatch.setattr(collocations, "_places", lambda hashes, bits: (hashes % np.uint64(3)).astype(np.int64))
    texts = collocations._candidates(collocations.Chunk("en", collocations.words_of("a b c. a b")), 1, 16, None)
    assert texts.tolist() == [True, True, True, False, True, True, False]


def test_collocations_equal_brute_force(spark):
    rows = spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(MADE)], "doc_id long, text string, lang string")
    for first in (2, 2000):
        found = collocations.top(collocations.scored(collocations.frequent_phrases(rows, least=4, bits=16)), first)
        got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()]
        assert set(got) == collocations_by_force(MADE, 4, first) and len(set(got)) == len(got)


def test_collocation_scores_are_exact(spark):
    """Products beyond 64 bits."""
    big = 9 * 10**17
    rows = spark.createDataFrame([("en", "a", 1, big + 7, 1), ("en", "b", 1, big + 2, 1), ("en", "a b", 2, big, 1), ("en", "c", 1, big, 1), ("en", "a b c", 3, 8 * big // 10 - 1, 1), ("en", "b c", 2, big + 1, 1)], "lang string, phrase string, size int, f long, n long")
    got = {r.phrase: r.score for r in collocations.scored(rows).collect()}
    assert got["a b"] == 2_000_000 * big // (2 * big + 9) and set(got) == {"a b", "b c", "a b c"}
    same = rows.withColumn("f", F.when(F.col("phrase") == "a b c", F.lit(8 * big // 10)).otherwise(F.col("f")))
    assert {r.phrase for r in collocations.scored(same).collect()} == {"b c", "a b c"}


def test_collocations_equal_sql(spark, data):
    want = duckdb.sql(queries.OP12_SQL.replace("FROM documents", f"FROM '{data}/documents.parquet'")).fetchall()
    got = [tuple(r) for r in queries.op12_collocations(spark, data).collect()]
    assert len(got) == len(want) > 100 and set(got) == set(want)


def test_collocations_odd(odd, empty):
    given = odd.select("doc_id", "text", F.col("__text").alias("lang"), "score", "ids")
    rows = [(r.lang, r.text) for r in given.collect()]
    want, _ = phrases_by_force(rows, 2)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in collocations.frequent_phrases(given, least=2, bits=16).collect()} == want
    none = collocations.frequent_phrases(empty.withColumnRenamed("score", "lang"), bits=16)
    assert none.count() == 0 and collocations.top(collocations.scored(none)).count() == 0


# --- packing ----------------------------------------------------------------------------------


def checked(pieces, wanted, length):
    """Every id in one piece, no padding but none needed at powers of two; returns the sequences."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length, r.doc_id))
        docs[r.doc_id].append(r)
    for places in sequences.values():
        at = 0
        for offset, n, _ in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
    for doc, ids in wanted.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert (bytes(r.ids) == part) if "ids" in r else (r.ids_crc32 == zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    return sequences


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(W)


def test_packing_of_the_table(spark, data, word_library):
    given = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    wanted = {d: word_library.encode(t or "", add_special_tokens=False).ids + [2] for d, t in given}
    got = queries.op13_packing(spark, data).collect()
    sequences = checked(got, wanted, 4096)
    total = sum(map(len, wanted.values()))
    assert sum(sum(n for _, n, _ in s) == 4096 for s in sequences.values()) >= total // 4096 - 8


def test_packing_odd(odd, empty, word_library):
    rows = odd.withColumn("doc_id", F.monotonically_increasing_id())
    wanted = {r.doc_id: word_library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows.collect()}
    checked(packing.pack(rows, W, 2, length=64).collect(), wanted, 64)
    assert packing.pack(odd, W, 2).agg(F.sum("length")).first()[0] == sum(map(len, wanted.values()))
    assert packing.pack(empty, W, 2).count() == 0


def test_cutter_tail():
    for total in (*range(1, 40), 64, 127, 128, 129):
        cutter = packing.Cutter(64)
        found = [*cutter.add("a", np.arange(total // 3)), *cutter.add("b", np.arange(total // 3, total)), *cutter.close()]
        assert np.concatenate([p[3] for p in found]).tolist() == list(range(total))
        sizes = Counter()
        for _, _, n, _, sequence, _ in found:
            sizes[sequence] += n
        assert all(n & (n - 1) == 0 for n in sizes.values())


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3)])
def test_hilbert_curve_goes_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    along = cells[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_are_alike(spark, data):
    """Documents that follow one another on the curve share their language more often than chance has it."""
    rows = spark.read.parquet(f"{data}/documents.parquet")
    lang = dict(duckdb.sql(f"SELECT doc_id, coalesce(lang, '') FROM '{data}/documents.parquet'").fetchall())
    held = packing.on_curve(packing.encoded(rows, W, 2)).select("doc_id", "key").orderBy("key", "doc_id").collect()
    along = [lang[r.doc_id] for r in held]
    same = sum(a == b for a, b in zip(along, along[1:])) / (len(along) - 1)
    chance = sum((n / len(along)) ** 2 for n in Counter(along).values())
    assert same > chance + 0.2
