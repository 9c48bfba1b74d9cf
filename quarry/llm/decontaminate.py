"""Benchmark decontamination by suffix arrays over the training text.

Documents go by in shards of bounded text inside the tasks.  Each shard gets an array of its suffixes, sorted by
their first words: prefix doubling gives every place the rank that its run of 1, 2, 4, ... words has among the runs of
the benchmark, and a suffix that starts with a run of no item drops out at once.  Every suffix of every item is
looked up in the array by binary search, all in one pass, and each match is extended to its full verbatim
length.  Words are compared as they are, not by hashes.  A shard costs its own words and one search for each
window of the benchmark, so shards are large.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters.  A window is
`window` consecutive words of an item; an item with fewer words, but not none, is one window.

Edge cases: null or empty texts have no words; items without words are never found; items with the
same item_id count as one, and a null item_id is the empty one; long texts are searched whole; an empty benchmark hits
nothing; further columns are ignored.  Items go to the tasks in slices of at most about `slice_words` words: what a slice
finds is written before the next one comes to the driver, so that no more than one is held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import packed, unpacked, written
from ._streams import pieces
from ._words import ALNUM, words

WINDOW = 10
#: Words of benchmark items that go to the tasks at once.
SLICE_WORDS = 2_000_000
#: Words of documents in a suffix array, about, and bytes of their rows.
SHARD_WORDS, SHARD_BYTES = 500_000, 12 << 20


class _Numbers(dict):
    """Words to numbers from 1; 0 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Suite:
    """Benchmark items as word numbers, and the ranks of their runs."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.ids, self.vocabulary = window, [], _Numbers()
        texts = []
        for name, text in items:
            own = words(text, ALNUM)
            if own:
                self.ids.append(name)
                texts.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own])
        self.lengths = np.array([len(x) for x in texts], dtype=np.int64)
        self.starts = np.cumsum(np.concatenate(([0], self.lengths + 1)))[:-1]
        #: All items, one after the other, each followed by a 0.
        self.text = np.array([n for x in texts for n in (*x, 0)], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.lengths + 1)
        self._runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: For each length of windows: (places of the items' windows, their ranks).
        self.windows = {}
        for size in sorted({min(window, n) for n in self.lengths.tolist()}):
            each = self.lengths == size if size < window else self.lengths >= window
            places = np.concatenate([np.arange(a, a + n - size + 1) for a, n in zip(self.starts[each], self.lengths[each])])
            self.windows[size] = places, self.ranks(self.text, size)[places]

    def numbers(self, own: list[bytes]) -> np.ndarray:
        """Word numbers of a text; 0 for words of no item."""
        return np.fromiter(map(self.vocabulary.__getitem__, own), dtype=np.int64, count=len(own))

    def _level(self, left: np.ndarray, right: np.ndarray, size: int, learn: bool) -> np.ndarray:
        """Ranks from 1 of runs of `size` words by the ranks of their two parts; 0 for runs of no item."""
        pair = np.where((left > 0) & (right > 0), left << 32 | right, 0)
        if learn:
            self._runs[size] = np.unique(pair[pair > 0])
        known = self._runs[size]
        if not len(known):
            return np.zeros(len(pair), dtype=np.int64)
        out = np.zeros(len(pair), dtype=np.int64)
        alive = np.flatnonzero(pair)
        at = np.minimum(np.searchsorted(known, pair[alive]), len(known) - 1)
        out[alive] = np.where(known[at] == pair[alive], at + 1, 0)
        return out

    def ranks(self, text: np.ndarray, size: int) -> np.ndarray:
        """The rank of the run of `size` words at each place of a text among those of the items; 0 where it's none of theirs.

        Ranks ascend as the runs do word by word.  Runs of the length and of those it is made of are learnt from the items first.
        """
        learn = text is self.text

        def shifted(x: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate((x[by:], np.zeros(min(by, len(x)), dtype=x.dtype)))

        out, width = text, 1
        while 2 * width <= size:
            out = self._level(out, shifted(out, width), 2 * width, learn and 2 * width not in self._runs)
            width *= 2
        # the two parts may overlap: order by the first, then the second, is still order by words
        return self._level(out, shifted(out, size - width), size, learn and size not in self._runs) if size > width else out


class Shard:
    """A suffix array over the words of some documents."""

    def __init__(self, suite: Suite, numbers: list[np.ndarray]):
        self.suite = suite
        self.starts = np.cumsum([0] + [len(x) + 1 for x in numbers])
        #: All documents, one after the other, each followed by a 0.
        self.text = np.zeros(int(self.starts[-1]), dtype=np.int64)
        for at, x in zip(self.starts.tolist(), numbers):
            self.text[at : at + len(x)] = x

    def suffixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of suffixes that can match a window of `size` words, in order of those words, and their ranks."""
        ranks = self.suite.ranks(self.text, size)
        places = np.flatnonzero(ranks)
        places = places[np.argsort(ranks[places], kind="stable")]
        return places, ranks[places]

    def matches(self):
        """(document, first word, length, item, item's first word) of every maximal verbatim match."""
        suite = self.suite
        for size, (wanted, wanted_ranks) in suite.windows.items():
            places, ranks = self.suffixes(size)
            if not len(places):
                continue
            lo, hi = np.searchsorted(ranks, wanted_ranks), np.searchsorted(ranks, wanted_ranks, side="right")
            # one row for each pair of a suffix of the shard and one of an item, in slices of bounded size
            found = np.flatnonzero(hi > lo)
            ends = np.cumsum((hi - lo)[found])
            for cut in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
                number = np.arange(cut, min(cut + (1 << 20), int(ends[-1])))
                k = np.searchsorted(ends, number, side="right")
                at = places[lo[found[k]] + number - np.concatenate(([0], ends))[k]]
                item = wanted[found[k]]
                # the match that starts a word earlier has those that can be extended to the left
                before = np.where(at > 0, self.text[at - 1], 0)
                first = (before == 0) | (item == 0) | (before != suite.text[item - 1])
                at, item = at[first], item[first]
                length = np.full(len(at), size)
                going = np.arange(len(at))
                while len(going):
                    a, b = at[going] + length[going], item[going] + length[going]
                    same = self.text[a] == suite.text[b]
                    going = going[same & (self.text[a] > 0)]
                    length[going] += 1
                document = np.searchsorted(self.starts, at, side="right") - 1
                owner = suite.owner[item]
                yield from zip(document.tolist(), (at - self.starts[document]).tolist(), length.tolist(), owner.tolist(), (item - suite.starts[owner]).tolist())


def item_slices(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", slice_words: int = SLICE_WORDS):
    """The items in slices of about slice_words words: one slice for any usual benchmark."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    letters = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(letters) // (4 * slice_words)))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield n, [(r.item_id, r.text) for r in rows.collect()]


def find(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, shard_words: int = SHARD_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The `keep` columns of each document with n_words, n_hit, items (sorted array) and spans.

    spans has (first word, words, item_id, item's first word) of each maximal match.  A map over
    the documents without a shuffle; with several slices of items each goes over what the ones
    before it returned.
    """
    own = [c for c in keep if c != "text"]
    out = documents.select(*own, F.col("text").alias("__text"))
    out = out.withColumns({"__spans": F.expr("cast(array() as array<struct<first:int,words:int,item_id:string,item_first:int>>)"), "__n": F.lit(0)})
    names = out.columns
    schema = out.schema
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("item_id", pa.string()), ("item_first", pa.int32())]))

    for slices, items in item_slices(benchmark, slice_words=slice_words):
        suite = Suite(items, window)

        def scan(batches, suite=suite):
            held, numbers, size = [], [], 0

            def flush():
                found: dict[int, list] = {}
                for d, place, length, k, p in Shard(suite, numbers).matches():
                    found.setdefault(d, []).append({"first": place, "words": length, "item_id": suite.ids[k], "item_first": p})
                at = 0
                for batch in held:
                    spans, n = batch.column(names.index("__spans")), [len(x) for x in numbers[at : at + batch.num_rows]]
                    if any(at + k in found for k in range(batch.num_rows)):
                        spans = pa.array([before + found.get(at + k, []) for k, before in enumerate(spans.to_pylist())], kind)
                    columns = list(batch.columns)
                    columns[names.index("__spans")] = spans
                    columns[names.index("__n")] = pa.array(n, pa.int32())
                    at += batch.num_rows
                    yield pa.RecordBatch.from_arrays(columns, names)
                held.clear()
                numbers.clear()

            for batch in pieces(batches):
                found = [suite.numbers(words(t, ALNUM)).astype(np.int32) for t in batch.column(names.index("__text")).to_pylist()]
                held.append(batch)
                numbers += found
                size += sum(map(len, found))
                if size >= shard_words or sum(b.nbytes for b in held) >= SHARD_BYTES:
                    yield from flush()
                    size = 0
            if held:
                yield from flush()

        out = out.mapInArrow(scan, schema)
        if slices > 1:
            out = written(out, "matches")
    hits = F.expr(
        # length of the union of the spans, which are folded in order of their starts
        "aggregate(array_sort(__spans), named_struct('n', 0L, 'end', 0), (s, x) -> named_struct('n', s.n + greatest(x.first + x.words - greatest(x.first, s.end), 0),"
        " 'end', greatest(s.end, x.first + x.words)), s -> s.n)"
    )
    return out.select(
        *(F.col("__text").alias("text") if c == "text" else F.col(c) for c in keep),
        F.col("__n").cast("long").alias("n_words"),
        hits.alias("n_hit"),
        F.expr("array_sort(array_distinct(transform(__spans, x -> x.item_id)))").alias("items"),
        F.col("__spans").alias("spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of what find() returns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that no benchmark window occurs in."""
    return unpacked(find(packed(documents), benchmark, keep=("__row", "text"), **options).where("n_hit = 0"), documents.columns)
