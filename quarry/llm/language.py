"""Language identification by rank-order character n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (n = 1 to 3, words padded by
a boundary), most frequent first.  A document's own list is compared with every profile by the
out-of-place distance: the sum over the document's n-grams of how far the ranks differ, with the
profile's length as the distance of an n-gram that it lacks.  The nearest profile wins; ties go
to the name that sorts first.

Edge cases: null texts and texts without a letter get `und` with score 0; very long texts are
used whole; rows with a null language are never learnt from; an empty training table makes every
prediction `und`; repeated rows and rows with a repeated or null doc_id are scored like any other;
further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._streams import pieces

UNKNOWN = "und"
#: Stands for a word's edge; no letter.
EDGE = 1
#: n-grams kept of each profile and of each document.
PROFILE_SIZE = 300
#: Expected number of labelled rows of each language that profiles are fitted on, at most.
FIT_ROWS = 2000

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram codes of a text (three code points of 21 bits, EDGE as word boundary) and their counts."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate(([EDGE], np.where(letter, codes, EDGE), [EDGE]))
    codes = codes[np.concatenate(([True], (codes[1:] != EDGE) | (codes[:-1] != EDGE)))]
    pairs = (codes[:-1] << 21) | codes[1:]
    triples = (pairs[:-1] << 21) | codes[2:]
    grams = np.concatenate((codes[codes != EDGE], pairs, triples[codes[1:-1] != EDGE]))
    grams.sort()
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[starts], np.diff(starts, append=len(grams))


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return grams[np.lexsort((grams, -counts))[:size]]


def fit_profiles(training: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = PROFILE_SIZE, fit_rows: int = FIT_ROWS) -> dict[str, list[int]]:
    """Profiles by language: n-gram codes, most frequent first (ties by code).

    Counts are summed over the training rows on the executors; only `size` codes a language come
    to the driver.  Of a language with more than `fit_rows` rows a share chosen by a hash of the
    doc_id is used that has about that many.
    """
    rows = training.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.count("*")).alias("share"))
    chosen = (
        rows.join(F.broadcast(shares), "lang")
        .where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)) | F.col("doc_id").isNull())
        .select("lang", "text")
    )

    def count(batches):
        for batch in pieces(batches):
            found: dict[str, list] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(name, []).append(gram_counts(value))
            for name, parts in found.items():
                grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                if len(grams):
                    sums = np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(sums)], ["lang", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in ranked.select("lang", "gram", "place").collect():
        profiles.setdefault(row.lang, []).append((row.place, row.gram))
    return {name: [g for _, g in sorted(found)] for name, found in sorted(profiles.items())}


class Ranker:
    """The profiles as one table of ranks, for scoring texts inside tasks."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for name in self.names for g in profiles[name]], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        own = _top(grams, counts, self.size)
        at = np.searchsorted(self.grams, own)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.names[best], 1.0 - float(apart[best]) / (self.size * len(own))


def predict(documents: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE_SIZE) -> DataFrame:
    """The `keep` columns with lang_pred and score of each row; a map over the rows, no shuffle."""
    chosen = documents.select(*keep) if text in keep else documents.select(*keep, F.col(text).alias("__text"))
    place = keep.index(text) if text in keep else len(keep)
    schema = documents.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def score(batches):
        ranker = Ranker(profiles, size)
        for batch in pieces(batches):
            found = [ranker(t) for t in batch.column(place).to_pylist()]
            columns = batch.columns[: len(keep)] + [pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return chosen.mapInArrow(score, schema)
