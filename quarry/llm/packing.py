"""Packing of documents into token sequences along a space-filling curve.

1. A map encodes each text, hashes its ids into a vector of signed buckets (square roots, length 1) and projects that to a few
   numbers by a fixed random matrix.
2. The numbers' means and deviations over all documents place each document in a cell of a grid that the documents fill evenly;
   the cell's Hilbert key is its place on the curve.
3. Documents are sorted by ranges of their keys (one shuffle), and each task cuts the stream of its range into sequences of
   `length` ids.  So a sequence holds documents that are near each other on the curve.
4. What is left at a range's end is cut into sequences of powers of two, which need no padding.

Edge cases: null and empty texts have only the end id; documents with equal keys, copies among them, follow in order of
a number that each row gets once; rows with the same or a null doc_id are packed each by itself; texts longer than a sequence go over
as many as they need; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._streams import pieces
from .sstable import word_codec

BUCKETS, DIMS, BITS, SEED = 512, 3, 12, 7
#: Ids of a range, about.
RANGE_IDS = 1 << 22
#: Pieces that a task holds before it passes them on.
HELD = 4000


@lru_cache
def _projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the projection of buckets."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, BUCKETS, vocabulary), rng.choice((-1.0, 1.0), vocabulary), rng.normal(size=(BUCKETS, DIMS))


def coordinates(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """A row of DIMS numbers for each document; zeros for one without ids."""
    bucket, sign, matrix = _projection(vocabulary)
    out = np.zeros((len(ids), DIMS))
    for k, own in enumerate(ids):
        v = np.bincount(bucket[own], weights=sign[own], minlength=BUCKETS)
        v = np.sign(v) * np.sqrt(np.abs(v))
        size = np.sqrt(v @ v)
        if size > 0:
            out[k] = v @ matrix / size
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert key of each row of cell numbers (0 to 2**bits - 1 in every dimension), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    if bits * dims > 62:
        raise ValueError("keys of more than 62 bits")
    high = 1 << (bits - 1)
    q = high
    while q > 1:  # undo the turns of each level, the largest first
        low = q - 1
        for d in range(dims):
            turned = (x[d] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    q = high
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> b) & 1
    return key


def encoded(documents: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (a number of its own), doc_id, n_ids, the ids (little-endian, 2 bytes each where they fit, else 4) and the coordinates."""
    chosen = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["row", "doc_id", "n_ids", "ids", *(f"c{d}" for d in range(DIMS))]

    def run(batches):
        own = word_codec(tokenizer_path)
        kind = _kind(own.size, end_id)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in pieces(batches):
            ids = [np.frombuffer(raw + end, "<u4") for raw in own.encode_all(batch.column(2).to_pylist())]
            at = coordinates([x[:-1] for x in ids], own.size)
            raw = [x.astype(kind).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, ids)), pa.int64()), pa.array(raw, pa.binary()), *(pa.array(at[:, d]) for d in range(DIMS))], names)

    return chosen.mapInArrow(run, "row long, doc_id long, n_ids long, ids binary, " + ", ".join(f"c{d} double" for d in range(DIMS)))


def _kind(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def on_curve(rows: DataFrame) -> DataFrame:
    """Adds the Hilbert key; each number's place is its share by the normal distribution with all documents' mean and deviation."""
    names = [f"c{d}" for d in range(DIMS)]
    found = rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in names), *(F.stddev_pop(c).alias(f"dev_{c}") for c in names)).first()
    means, devs = ([found[f"{kind}_{c}"] or 0.0 for c in names] for kind in ("mean", "dev"))

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        share = np.vectorize(lambda v: 0.5 * (1 + erf(v / sqrt(2))), otypes=[float])
        z = [(c.to_numpy() - m) / (d or 1.0) for c, m, d in zip(columns, means, devs)]
        cells = np.column_stack([np.clip(share(v) * (1 << BITS), 0, (1 << BITS) - 1) if len(v) else v for v in z])
        return pd.Series(hilbert_keys(cells, BITS))

    return rows.withColumn("key", key(*names))


class Cutter:
    """Cuts a stream of documents into sequences; gives (document, start, length, ids, sequence, offset) of each piece."""

    def __init__(self, length: int):
        self.length, self.filled, self.sequence = length, 0, 0
        #: The pieces of the sequence that isn't full yet.
        self.open: list[tuple] = []

    def add(self, document, ids: np.ndarray):
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.length - self.filled)
            self.open.append((document, at, n, ids[at : at + n], self.sequence, self.filled))
            at, self.filled = at + n, self.filled + n
            if self.filled == self.length:
                yield from self.open
                self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def close(self):
        """The last pieces, in sequences of powers of two, the longest first."""
        left, self.open = self.open, []
        rest = self.filled
        size, filled = 1 << max(0, rest.bit_length() - 1), 0
        for document, at, n, ids, *_ in left:
            done = 0
            while done < n:
                take = min(n - done, size - filled)
                yield document, at + done, take, ids[done : done + take], self.sequence, filled
                done, filled = done + take, filled + take
                if filled == size:
                    rest, filled, self.sequence = rest - size, 0, self.sequence + 1
                    size = 1 << max(0, rest.bit_length() - 1)


def pack(documents: DataFrame, tokenizer_path: str, end_id: int, length: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each piece: doc_id, start (ids of its document before it), length, ids (binary, four bytes each, little-endian), doc_tokens,
    sequence_id and offset there.  All ids of all documents are in exactly one piece; no sequence has padding.

    sequence_id tells the range in its upper bits and the sequence in it in the lower 40: ascending along the curve.
    """
    rows = written(encoded(documents, tokenizer_path, end_id, text, doc_id), "packing-ids")
    total = rows.agg(F.sum("n_ids")).first()[0] or 0
    ordered = on_curve(rows).select("key", "row", "doc_id", "n_ids", "ids").repartitionByRange(1 + total // RANGE_IDS, "key", "row").sortWithinPartitions("key", "row")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def made(held, base):
        rows = [(doc, start, n, ids.astype("<u4").tobytes(), tokens, base + sequence, offset) for (doc, tokens), start, n, ids, sequence, offset in held]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(map(list, zip(*rows)), kinds)], names)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        cutter, held = Cutter(length), []
        for batch in pieces(batches):
            for doc, n, raw in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                held.extend(cutter.add((doc, n), np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")))
                if len(held) >= HELD:
                    yield made(held, base)
                    held = []
        held.extend(cutter.close())
        if held:
            yield made(held, base)

    return ordered.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of these."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
