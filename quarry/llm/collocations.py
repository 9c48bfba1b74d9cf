"""Frequent phrases by hashed bucket counts and Apriori pruning, and their collocation scores.

Texts are cut into pieces at punctuation and line ends, pieces into words.  Pass n over the documents counts phrases of n words exactly
and, in the same go, the phrases of n + 1 words by buckets of their hashes.  A phrase of n + 1 words is counted in the next
pass only if its bucket's total is at least the threshold and both its phrases of n words are frequent.  What the tasks need
for that are two bitmaps of 2**`bits` places (one of buckets, one of the hashes of frequent phrases), broadcast:
their size is fixed, whatever the corpus.  A bit that is set for another phrase's sake only costs a count; the
counts are of the phrases themselves, so the result is exact at every number of bits.

A task counts buckets up to the threshold in one small number a bucket (a total that reaches it in one task
needs no more), so its memory is 2**bits bytes; tasks' counts are added up in blocks.

Edge cases: null texts are empty; a null lang is `und`; empty texts and texts of signs have no words; very long texts are
counted whole; repeated rows count each time; ties of score go to the more frequent phrase, then to the smaller bytes;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import forget, written
from ._streams import groups as runs_of
from ._streams import pieces
from ._words import LOWER, U64, grams, hashed, mix, quick

BITS = 24
#: Buckets of a block of counts, and in how many parts the tasks' counts of a block are added up first.
BLOCK, PARTS = 1 << 14, 8
#: Bytes of text of one language whose phrases are told apart at once.
CHUNK = 2 << 20
#: A-Z in lower case, the signs that end a piece as line ends, and tabs as blanks.
TABLE = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else LOWER[b] for b in range(256))
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with END after each piece."""
    return _split(text.encode("utf-8", "replace").translate(TABLE) if text else b"")


def _split(raw: bytes) -> list[bytes]:
    return [*filter(None, raw.replace(b"\n", b" \n ").split(b" ")), END]


def _seed(lang: str) -> np.uint64:
    return hashed([b"lang " + lang.encode()])[0, 0]


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


class Chunk:
    """Words of one language, with the hashes of their phrases."""

    def __init__(self, lang: str, found: list[bytes]):
        self.words = found
        unique = list(dict.fromkeys(found))
        index = dict(zip(unique, range(len(unique))))
        self.ids = np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found))
        self.size = len(unique)
        self._single = mix(quick(unique) ^ _seed(lang))[self.ids]
        self._word = self.ids != index.get(END, -1)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n places from each one on are words of one piece."""
        out = self._word[: max(0, len(self.ids) - n + 1)].copy()
        for k in range(1, n):
            out &= self._word[k : k + len(out)]
        return out

    def hashes(self, n: int) -> np.ndarray:
        return grams(self._single, n)

    def counted(self, at: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
        """The different phrases of n words that begin at the given places, and how often each does; told apart by their words."""
        if not len(at):
            return [], np.empty(0, np.int64)
        if n == 1:
            code = self.ids[at]
        elif n == 2:
            code = self.ids[at] * self.size + self.ids[at + 1]
        else:
            ends = at if n == 3 else np.concatenate((at, at + 2))
            _, pair = np.unique(self.ids[ends] * self.size + self.ids[ends + 1], return_inverse=True)
            code = pair * self.size + self.ids[at + 2] if n == 3 else pair[: len(at)] * (2 * len(at)) + pair[len(at) :]
        _, first, times = np.unique(code, return_index=True, return_counts=True)
        return [b" ".join(self.words[k : k + n]).decode("utf-8", "replace") for k in at[first].tolist()], times


def _chunks(batches):
    """The chunks of (lang, text) batches: texts of one language in order, about CHUNK bytes each, a longer text whole."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def made(lang):
        del sizes[lang]
        return lang, Chunk(lang, _split(b"\n".join(held.pop(lang))))

    for batch in pieces(batches, 200):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text.encode("utf-8", "replace").translate(TABLE))
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sizes[lang] >= CHUNK or sum(sizes.values()) >= 4 * CHUNK:
                    yield made(max(sizes, key=sizes.__getitem__))
    for lang in [*held]:
        yield made(lang)


class Bitmaps:
    """What a pass prunes by: the buckets of its phrases and the frequent phrases one word shorter, as broadcast bitmaps."""

    def __init__(self, spark, buckets: bytes, shorter: bytes):
        self._sent = spark.sparkContext.broadcast((buckets, shorter))

    def open(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(x, np.uint8) for x in self._sent.value)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1


def _candidates(chunk: Chunk, n: int, bits: int, maps) -> np.ndarray:
    """Whether a phrase of n words that may be frequent begins at each place."""
    may = chunk.whole(n)
    if n > 1 and len(may):
        buckets, shorter = maps
        fit = _has(shorter, _places(chunk.hashes(n - 1), bits))
        at = np.flatnonzero(may & fit[:-1] & fit[1:])
        may = np.zeros_like(may)
        may[at[_has(buckets, _places(chunk.hashes(n)[at], bits))]] = True
    return may


def _pass(texts: DataFrame, n: int, least: int, longest: int, bits: int, maps: Bitmaps | None) -> DataFrame:
    """Counts of phrases of n words in chunks (lang, phrase, n) and, n being under `longest`, a task's counts of buckets of the
    next length (block, counts)."""
    kind = np.uint8 if least < 256 else np.uint32
    names = ["lang", "phrase", "n", "part", "block", "counts"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % PARTS
        opened = maps.open() if maps else None
        buckets = np.zeros(1 << bits, dtype=kind) if n < longest else None
        for lang, chunk in _chunks(batches):
            may = _candidates(chunk, n, bits, opened)
            phrases, times = chunk.counted(np.flatnonzero(may), n)
            size = len(phrases)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(phrases, pa.string()), pa.array(times, pa.int64()), *(pa.nulls(size, t) for t in (pa.int32(), pa.int32(), pa.binary()))], names)
            if buckets is not None and len(may) > 1:
                at = np.flatnonzero(may[:-1] & may[1:])
                places, times = np.unique(_places(chunk.hashes(n + 1)[at], bits), return_counts=True)
                buckets[places] = np.minimum(buckets[places].astype(np.int64) + times, least).astype(kind)
        if buckets is not None:
            for block in range(0, len(buckets), BLOCK):
                counts = buckets[block : block + BLOCK]
                if counts.any():
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64())), pa.array([part], pa.int32()), pa.array([block // BLOCK], pa.int32()), pa.array([counts.tobytes()])], names)

    return texts.mapInArrow(run, "lang string, phrase string, n long, part int, block int, counts binary")


def _added(counts: DataFrame, by: list[str], least: int) -> DataFrame:
    """The tasks' counts of each block added up, never above the threshold; a task holds one block at a time."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches):
        for key, rows in _sums(batches, len(by), kind, least):
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([rows.astype(kind).tobytes()])], [*by, "counts"])

    return counts.select(*by, "counts").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, ", ".join(f"{c} int" for c in by) + ", counts binary")


def _sums(batches, width: int, kind, least: int):
    key, total = None, None
    for batch in pieces(batches, 16):
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            more = np.frombuffer(row[width], kind).astype(np.int64)
            if row[:width] != key:
                if key is not None:
                    yield key, total
                key, total = row[:width], more
            else:
                total = np.minimum(total + more, least)
    if key is not None:
        yield key, total


def _bucket_bitmap(counts: DataFrame, least: int, bits: int) -> bytes:
    """The bitmap of buckets that reach the threshold: 2**bits / 8 bytes come to the driver."""
    kind = np.uint8 if least < 256 else np.uint32
    summed = _added(_added(counts, ["block", "part"], least), ["block"], least)

    def run(batches):
        for batch in pieces(batches, 16):
            packed = [np.packbits(np.frombuffer(c, kind) >= least).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["block", "bits"])

    return _assembled(summed.mapInArrow(run, "block int, bits binary"), bits)


def _phrase_bitmap(frequent: DataFrame, n: int, bits: int) -> bytes:
    """The bitmap of the hashes of frequent phrases of n words."""

    def run(batches):
        for batch in pieces(batches, 10_000):
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            single = quick([w for p in phrases for w in p.encode("utf-8", "replace").split(b" ")])
            seeds = {k: _seed(k) for k in set(langs)}
            single = mix(single ^ np.repeat(np.array([seeds[k] for k in langs], dtype=U64), n))
            yield pa.RecordBatch.from_arrays([pa.array(_places(grams(single, n)[::n], bits))], ["place"])

    places = frequent.select("lang", "phrase").mapInArrow(run, "place long").select(F.floor(F.col("place") / BLOCK).cast("int").alias("block"), (F.col("place") % BLOCK).cast("int").alias("at"))

    def pack(batches):
        for (block,), rows in runs_of(batches, 1):
            held = np.zeros(BLOCK, dtype=bool)
            held[[r[0] for r in rows]] = True
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(held).tobytes()])], ["block", "bits"])

    return _assembled(places.distinct().repartition("block").sortWithinPartitions("block").mapInArrow(pack, "block int, bits binary"), bits)


def _assembled(blocks: DataFrame, bits: int) -> bytes:
    out = bytearray((1 << bits) // 8)
    for r in blocks.toLocalIterator():
        at = r.block * (BLOCK // 8)
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


def frequent_phrases(documents: DataFrame, least: int = 30, longest: int = 4, bits: int = BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase (its words joined by blanks), size (its number of words), f (all its occurrences) and n (all words of the lang) of
    the phrases of up to `longest` words that occur at least `least` times in their lang."""
    if bits < 16 or longest > 4:
        raise ValueError("bits must be 16 at least, and phrases are of four words at most")
    texts = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    maps, tables, totals = None, [], None
    for n in range(1, longest + 1):
        held = written(_pass(texts, n, least, longest, bits, maps), "collocation-counts")
        counts = held.where("phrase is not null")
        if n == 1:
            totals = written(counts.groupBy("lang").agg(F.sum("n").alias("words")), "collocation-totals")
        found = written(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "collocations")
        tables.append(found.withColumn("size", F.lit(n)))
        if n < longest:
            maps = Bitmaps(documents.sparkSession, _bucket_bitmap(held.where("block is not null"), least, bits), _phrase_bitmap(found, n, bits))
        forget(held)
    out = tables[0]
    for more in tables[1:]:
        out = out.unionAll(more)
    return out.join(F.broadcast(totals), "lang").select("lang", "phrase", "size", "f", F.col("words").alias("n"))  # a row a lang


def scored(phrases: DataFrame, factor: int = 2_000_000, inside: int = 80) -> DataFrame:
    """The candidates (two words and more) among frequent phrases: lang, phrase, a, l, r, n, score.

    Of the cuts in two the one with the lowest score floor(factor * a / (l + r)) counts, the earliest at a tie.  Candidates that stand
    in a longer one with at least `inside` % of their count are left out.  A phrase's parts are at least as frequent, so all are there.
    """
    words, size = F.split("phrase", " "), F.col("size")
    longer = phrases.where(size > 1).select("lang", "phrase", "size", F.col("f").alias("a"), "n")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"head": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice(words, F.col("k") + 1, size - F.col("k")), " ")})
    part = phrases.select("lang", "phrase", "f")
    heads = part.select(F.col("lang"), F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = part.select(F.col("lang"), F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    exact = F.lit(factor).cast("decimal(8,0)") * F.col("a").cast("decimal(19,0)")
    both = both.withColumn("top", exact).withColumn("under", F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)"))
    best = both.withColumn("score", F.expr("top div under")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the parts of two words and more of each longer candidate
    starts = longer.where(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    starts = starts.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    within = starts.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(4,0)")
    covered = F.coalesce(wide("longest", 100) >= wide("a", inside), F.lit(False))
    return best.join(within, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def top(candidates: DataFrame, first: int = 2000, salts: int = 64) -> DataFrame:
    """The first candidates of each lang by score, count and phrase, with their rank; each lang is ranked in parts first."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    names = candidates.columns
    part = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    some = candidates.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= first)
    ranked = some.select(*names).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= first)
