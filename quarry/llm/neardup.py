"""Near-duplicate detection by MinHash.

A document's set holds its distinct 5-word shingles (with fewer words, the whole sequence).
Documents with equal sets form a class at once; one of each class goes on, so copies never meet in
pairs.  Universal hash minima are cut into bands; documents that agree on a band share a bucket.

1. In each bucket every member is paired with the smallest one only.  Pairs whose signatures agree
   well enough are confirmed on full sets; confirmed links give components.
2. Buckets that still hold several components are gone through again: their members are compared
   by signature across components, in blocks of bounded size, and what could be a link is confirmed
   on full sets.  Members of one component aren't compared any more, so a large group of near
   copies costs what its members cost, not its pairs.  No bucket is capped.

Links are 100 * intersection >= similarity * union.  Shingles are told apart by 64 bits mixed from SipHashes
of their words, so the sets of a compared pair are wrong only if two of their own shingles collide (a chance
below 1e-9 for two texts of 100,000 words).  With 28 bands of 4 minima a pair at 0.75 shares no
band with probability 2e-5; the signature test drops a pair at 0.75 with probability below 1e-5.

Edge cases: null texts and texts without words have an empty set and are linked with nothing; long
texts are used whole; rows with the same doc_id are judged each by its own set, and where such a doc_id
stands for several classes these count as linked; rows with a null doc_id are linked with nothing, have a null component and are kept;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._streams import groups, pieces
from ._words import LOWER, U64, grams, mix, quick, words
from .components import components

SHINGLE = 5
SIMILARITY = 75
BANDS = 28
ROWS = 4
#: Least share of equal minima of a pair that is confirmed on full sets.
AGREEMENT = 0.55
#: Members of a bucket that are compared at once.
BLOCK = 2048
#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000

_draw = np.random.Generator(np.random.PCG64(20240607))
_A = (_draw.integers(0, 1 << 63, BANDS * ROWS, dtype=U64) << U64(1)) | U64(1)
_B = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=U64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    hashes = quick(words(text, LOWER))
    return np.unique(grams(hashes, min(size, len(hashes)))) if len(hashes) else np.empty(0, U64)


def minima(found: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash (multiply-shift on 32 bits) over a set of shingles."""
    least = np.full(len(_A), np.iinfo(np.uint32).max, dtype=np.uint32)
    high = found >> U64(32)
    for at in range(0, len(high), 4096):
        part = ((_A[:, None] * high[at : at + 4096] + _B[:, None]) >> U64(32)).astype(np.uint32)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    return grams(np.concatenate((least.astype(U64), [U64(0)])), ROWS)[: BANDS * ROWS : ROWS] ^ mix(np.arange(BANDS, dtype=U64) + U64(77))


def signatures(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, the two halves of the set's BLAKE2 digest, sig (one byte a minimum) and bands."""

    def run(batches):
        for batch in pieces(batches):
            n, prints, sig, bands = [], [], [], []
            for found in map(shingles, batch.column(1).to_pylist()):
                least = minima(found)
                n.append(len(found))
                prints.append(blake2b(found.tobytes(), digest_size=16).digest())
                sig.append(mix(least.astype(U64)).astype(np.uint8).tobytes())
                bands.append(_bands(least).astype(np.int64) if len(found) else [])
            first, second = (pa.array(x) for x in np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2).T.copy())
            columns = [batch.column(0), pa.array(n, pa.int64()), first, second, pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "fp_a", "fp_b", "sig", "bands"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, fp_a long, fp_b long, sig binary, bands array<long>")


def _sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and members (sorted 64-bit hashes as bytes) of the documents named by ids."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches):
        for batch in pieces(batches):
            found = [shingles(text).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "members"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, members binary")


def linked(x: np.ndarray, y: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < similarity * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= similarity * (len(x) + len(y) - both)


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures and set sizes allow a link."""
    light = nodes.select("doc_id", "n_shingles", "sig")
    rows = pairs.join(light.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("s_a")), "a")
    rows = rows.join(light.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("s_b")), "b")
    rows = rows.where(f"100 * least(n_a, n_b) >= {SIMILARITY} * greatest(n_a, n_b)").select("a", "b", "s_a", "s_b")

    def run(batches):
        for batch in pieces(batches):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                good = np.flatnonzero((x == y).mean(axis=1) >= AGREEMENT)
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good)) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links by their full sets."""
    rows = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("m_b")), "b")
    rows = rows.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("m_a")), "a").select("a", "b", "m_a", "m_b")

    def run(batches):
        for batch in pieces(batches):
            found = [linked(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(found, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds i and j, so that any two members of a bucket meet in one group (key, i, j); own is a row's block."""
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def _possible(k: int, comp: np.ndarray, own: np.ndarray, size: np.ndarray, sig: np.ndarray, start: int = 0) -> np.ndarray:
    """Places from `start` of the group's rows that row k could have a link to across components."""
    other = np.flatnonzero((comp[start:] != comp[k]) & (100 * np.minimum(size[start:], size[k]) >= SIMILARITY * np.maximum(size[start:], size[k]))) + start
    if own.min() != own.max():
        other = other[own[other] != own[k]]
    return other[(sig[other] == sig[k]).mean(axis=1) >= AGREEMENT] if len(other) else other


def _remaining(members: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(key, i, j, doc_id, component, own) of bucket members that could have a link to another component."""
    placed = members.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("n > 2 and lo < hi").select("key", "n")
    rows = _blocks(placed.join(mixed, "key")).join(nodes.select("doc_id", "n_shingles", "sig"), "doc_id")
    rows = rows.select("key", "i", "j", "doc_id", "component", "own", "n_shingles", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for key, group in groups(batches, 3):
            comp, own, size = (np.array([r[k] for r in group], dtype=np.int64) for k in (1, 2, 3))
            sig = np.frombuffer(b"".join(r[4] for r in group), np.uint8).reshape(len(group), -1)
            chosen = [r for k, r in enumerate(group) if len(_possible(k, comp, own, size, sig))]
            if chosen:
                columns = [pa.array([x] * len(chosen), kind) for x, kind in zip(key, (pa.int64(), pa.int32(), pa.int32()))]
                columns += [pa.array(c, kind) for c, kind in zip(zip(*chosen), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "i", "j", "doc_id", "component", "own", "n_shingles", "sig"])

    return rows.mapInArrow(run, "key long, i int, j int, doc_id long, component long, own int, n_shingles long, sig binary")


def _late_links(remaining: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the remaining members, confirmed on full sets; within a group only those that join components."""
    rows = remaining.join(sets, "doc_id").select("key", "i", "j", "doc_id", "component", "own", "n_shingles", "sig", "members").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for _, group in groups(batches, 3):
            comp, own, size = (np.array([r[k] for r in group], dtype=np.int64) for k in (1, 2, 3))
            sig = np.frombuffer(b"".join(r[4] for r in group), np.uint8).reshape(len(group), -1)
            held = [np.frombuffer(r[5], U64) for r in group]
            parent: dict[int, int] = {}
            links = []

            def top(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for k in range(len(group)):
                for m in _possible(k, comp, own, size, sig, k + 1).tolist():
                    p, q = top(int(comp[k])), top(int(comp[m]))
                    if p != q and linked(held[k], held[m]):
                        parent[max(p, q)] = min(p, q)
                        links.append((group[k][0], group[m][0]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def find(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept of each row."""
    documents = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(signatures(documents), "signatures")
    class_of = ["fp_a", "fp_b", "n_shingles"]
    nodes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*class_of).agg(F.min(F.struct("doc_id", "sig", "bands")).alias("rep"))
    nodes = written(nodes.select(*class_of, "rep.*"), "classes")
    banded = nodes.select("doc_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(buckets, "key"), "buckets")

    star = members.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    agreeing = written(_agreeing(star, nodes), "pairs")
    ids = agreeing.select(F.col("a").alias("doc_id")).union(agreeing.select("b")).union(members.where("n > 2").select("doc_id"))
    sets = written(_sets(documents, written(ids.distinct(), "ids")), "sets")
    links = written(_confirmed(agreeing, sets), "links")
    found = components(links)
    late = written(_late_links(_remaining(members, nodes, found), sets), "late-links")
    if late.take(1):
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late))

    classes = nodes.select(*class_of, F.col("doc_id").alias("rep"))
    rows = signed.select("doc_id", *class_of).join(classes, class_of, "left")
    rows = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are kept: one doc_id of each component.

    Rows that share a doc_id stay or go together: they stay if one of them is kept.
    """
    gone = find(documents).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    gone = written(gone.select("doc_id"), "duplicates").select(F.col("doc_id").alias("__gone"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return documents.join(gone, documents["doc_id"] == gone["__gone"], "left_anti")
