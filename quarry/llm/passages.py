"""Substring deduplication: passages that recur anywhere are found and removed.

A window is `window` consecutive words of a document.  Words covered by a window whose word sequence
also starts anywhere else, in the same document or another, are removed.

1. Anchors.  Of the `anchor`-word grams in every window the one with the least hash is the window's
   anchor, so equal windows have equal anchors; about one gram in ten is chosen.  Only windows
   whose anchor occurs twice can recur.  Anchors with more than 1 / HOT of all occurrences, fewer than HOT, are
   joined by broadcast, so that none of them meets in one task.
2. Confirmed passages.  The windows of such anchors are counted by 128 bits made from the BLAKE2 digests of
   their words.  Of every window that recurs the first instance is kept; runs of such windows, cut into pieces
   that overlap, are the recurring passages, and each recurring window stands in exactly one of them.
3. Automata.  Documents that could hold a passage are dealt into shards of bounded text, and each
   passage goes to the shards whose documents share a key with it: an anchor or, where an anchor occurs more
   than COMMON times, the hash of a window round it.  So what an anchor adds to the shards is bounded by COMMON for each
   occurrence, and a common line brings a shard only passages that stand in it.  Blocks of a shard's passages,
   chosen so that every window holds a whole one, are compiled into an Aho-Corasick automaton
   over words; the shard's documents stream through it, and each block found is extended, word by word, to the
   longest common run with its passage.  Runs of at least a window are removed.

Edge cases: null texts have no words; documents shorter than a window lose nothing; texts of any length
are used whole; rows with the same doc_id are separate documents, and equal rows are copies of each
other; ties of anchors go to the earlier gram; empty tables give an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written
from ._streams import pieces
from ._words import U64, grams, hashed, quick, words

WINDOW = 35
ANCHOR = 18
#: Anchors above this share of all occurrences are broadcast (fewer than HOT); above so many they are told apart by windows.
HOT, COMMON = 5000, 256
#: Windows of a passage at most.
PIECE = 128
_PLACES = 1 << 20
#: Characters of candidate documents in a shard, about.
SHARD_CHARS = 5_000_000
#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000


def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each window of a document, and the hash of the gram at each place."""
    found = grams(hashes, anchor)
    if len(hashes) < window:
        return np.empty(0, np.int64), found
    many = window - anchor + 1
    if len(found) > _PLACES:
        seen = np.lib.stride_tricks.sliding_window_view(found >> U64(20), many)
        return np.concatenate([seen[at : at + 65536].argmin(axis=1) for at in range(0, len(seen), 65536)]) + np.arange(len(seen)), found
    # the place stands in the low bits, so that a minimum says where it is; minima of longer runs come from those of shorter ones
    least, width = found >> U64(20) << U64(20) | np.arange(len(found), dtype=U64), 1
    while 2 * width <= many:
        least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
    rest = many - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return (least & U64(_PLACES - 1)).astype(np.int64), found


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """rid and anchor of each chosen gram."""

    def run(batches):
        for batch in pieces(batches):
            rid, value = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chosen, found = anchors(quick(words(text)), window)
                chosen = np.unique(chosen)
                rid.append(np.full(len(chosen), key, dtype=np.int64))
                value.append(found[chosen].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rid, value)], ["rid", "anchor"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, anchor long")


def window_hashes(own: list[bytes], start: np.ndarray, window: int) -> np.ndarray:
    """The 128-bit hashes of the windows at these ascending places: two numbers a row."""
    out = np.empty((len(start), 2), dtype=np.int64)
    for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(start) > window) + 1) if len(start) else ():
        a, b = int(start[part[0]]), int(start[part[-1]])
        out[part] = grams(hashed(own[a : b + window]), window)[start[part] - a].astype(np.int64)
    return out


def _window_rows(rows: DataFrame, window: int) -> DataFrame:
    """wa and wb (hash), rid and start of the windows whose anchor is one of the row's."""

    def run(batches):
        for batch in pieces(batches, 100):
            hashes, rid, first = [], [], []
            for key, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                own = words(text)
                chosen, found = anchors(quick(own), window)
                start = np.flatnonzero(np.isin(found[chosen].astype(np.int64), np.array(wanted)))
                hashes.append(window_hashes(own, start, window))
                rid.append(np.full(len(start), key, dtype=np.int64))
                first.append(start.astype(np.int32))
            wa, wb = np.concatenate(hashes).T.copy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (wa, wb, np.concatenate(rid), np.concatenate(first))], ["wa", "wb", "rid", "start"])

    return rows.select("rid", "text", "anchors").mapInArrow(run, "wa long, wb long, rid long, start int")


def _passage_rows(rows: DataFrame, window: int) -> DataFrame:
    """passage (text) with its keys, for each piece of a run of the row's starts."""

    def run(batches):
        for batch in pieces(batches, 100):
            out, keys = [], []
            for text, starts, common in zip(*(c.to_pylist() for c in batch.columns)):
                own = words(text)
                at = np.unique(np.array(starts))
                chosen, found = anchors(quick(own), window)
                key = found[chosen[at]].astype(np.int64)
                apart = np.isin(key, np.array(common, dtype=np.int64))
                key[apart] = window_hashes(own, at[apart], window)[:, 0]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1):
                    for lo in range(0, len(part), PIECE):
                        piece = part[lo : lo + PIECE]
                        out.append(b" ".join(own[int(at[piece[0]]) : int(at[piece[-1]]) + window]).decode())
                        keys.append(np.unique(key[piece]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["passage", "keys"])

    return rows.select("text", "starts", "common").mapInArrow(run, "passage string, keys array<long>")


class _Numbers(dict):
    """Words to numbers from 1; 0 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Automaton:
    """Aho-Corasick over the words of a shard's passages."""

    def __init__(self, passages: list[str], window: int = WINDOW):
        self.window = window
        self.block = (window + 1) // 2
        self.vocabulary = _Numbers()
        self.numbers = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(p)] for p in passages]
        self.passages = [np.array(x, dtype=np.int32) for x in self.numbers]
        places: dict[tuple, list[tuple[int, int]]] = {}
        for k, numbers in enumerate(self.numbers):
            windows = len(numbers) - window + 1
            # a block at `at` is whole in the windows that start up to window - block words before it
            for at in [*range(window - self.block, windows - 1, window - self.block + 1), windows - 1]:
                places.setdefault(tuple(numbers[at : at + self.block]), []).append((k, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, found in places.items():
            self.automaton.add_word(block, found)
        if places:
            self.automaton.make_automaton()

    def covered(self, own: list[bytes]) -> np.ndarray:
        """For each word of a document whether a run shared with a passage covers it."""
        gone = np.zeros(len(own), dtype=bool)
        if len(own) < self.window or not len(self.automaton):
            return gone
        numbers = tuple(map(self.vocabulary.__getitem__, own))
        every = np.array(numbers, dtype=np.int32)
        more = self.window - self.block
        seen: dict[tuple[int, int], int] = {}  # (passage, shift) -> end of the last run
        for end, found in self.automaton.iter(numbers):
            first = end - self.block + 1
            for k, place in found:
                shift = first - place
                if seen.get((k, shift), -1) > end:
                    continue
                other = self.numbers[k]
                lo, hi = max(0, shift), min(len(numbers), shift + len(other))
                a, b = first, end + 1
                while a > lo and first - a < more and numbers[a - 1] == other[a - 1 - shift]:
                    a -= 1
                while b < hi and b - a < self.window and numbers[b] == other[b - shift]:
                    b += 1
                if b - a < self.window:  # the run round this block is too short
                    seen[k, shift] = b
                    continue
                differ = np.flatnonzero(every[lo:hi] != self.passages[k][lo - shift : hi - shift]) + lo
                cut = int(np.searchsorted(differ, first))
                a = int(differ[cut - 1]) + 1 if cut else lo
                b = int(differ[cut]) if cut < len(differ) else hi
                seen[k, shift] = b
                gone[a:b] = True
        return gone


def _kept(own: list[bytes], gone: np.ndarray | None = None) -> str:
    return hashlib.sha256(b" ".join(own if gone is None else compress(own, (~gone).tolist()))).hexdigest()


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _whole(rows: DataFrame) -> DataFrame:
    """The result of documents that lose nothing."""

    def run(batches):
        for batch in pieces(batches):
            found = map(words, batch.column(1).to_pylist())
            yield _result([(doc, len(own), 0, _kept(own)) for doc, own in zip(batch.column(0).to_pylist(), found)])

    return rows.select("doc_id", "text").mapInArrow(run, _RESULT)


def _stream(rows: DataFrame, window: int) -> DataFrame:
    """Rows are sorted by shard and kind: a shard's passages (kind 0), then its documents (kind 1)."""

    def run(batches):
        shard, passages, automaton = None, [], None
        for batch in pieces(batches):
            out = []
            for number, kind, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if number != shard:
                    shard, passages, automaton = number, [], None
                if kind == 0:
                    passages.append(text)
                    continue
                if automaton is None:
                    automaton, passages = Automaton(passages, window), []
                own = words(text)
                gone = automaton.covered(own)
                out.append((doc, len(own), int(gone.sum()), _kept(own, gone)))
            yield _result(out)

    return rows.select("shard", "kind", "doc_id", "text").mapInArrow(run, _RESULT)


def remove(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words that stay, joined by a space) of each row."""
    rows = _numbered(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    chosen = written(_anchor_rows(rows, window), "anchors")
    counts = written(chosen.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
    hot = F.broadcast(counts.where(F.col("n") > max(COMMON, chosen.count() // HOT)))
    rest = chosen.join(hot.select("anchor"), "anchor", "left_anti").join(counts, "anchor")
    twice = chosen.join(hot, "anchor").select(rest.columns).union(rest).withColumn("common", F.col("n") > COMMON)
    places = twice.groupBy("rid").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("common"), F.col("anchor"))).alias("common"))
    places = written(places.withColumn("lead", F.array_min("anchors")), "shared-anchors")
    forget(chosen, counts)
    ids = places.select("rid")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    held = rows.join(ids, "rid", "left_semi")
    placed = held.join(places, "rid")

    windows = _window_rows(placed, window)
    first = windows.groupBy("wa", "wb").agg(F.count("*").alias("n"), F.min(F.struct("rid", "start")).alias("at")).where("n > 1")
    starts = first.groupBy("at.rid").agg(F.collect_list("at.start").alias("starts"))
    passages = written(_passage_rows(placed.join(starts, "rid"), window).distinct(), "passages")

    # documents with the same least anchor, copies for the most part, share a shard, or several if their text is too much for one
    groups = written(placed.groupBy("lead").agg(F.sum(F.length("text")).alias("chars")), "groups")
    shards = max(1, -(-int(groups.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]) // shard_chars))
    part = F.pmod(F.xxhash64("rid"), F.ceil(F.col("chars") / shard_chars))
    dealt = places.join(groups, "lead").withColumn("shard", F.pmod(F.xxhash64("lead", part), F.lit(shards)).cast("int"))
    dealt = written(dealt.select("rid", "shard", F.array_except("anchors", "common").alias("anchors"), "common"), "dealt")
    round_common = _window_rows(held.join(dealt.where(F.size("common") > 0).select("rid", F.col("common").alias("anchors")), "rid"), window)
    round_common = round_common.join(dealt.select("rid", "shard"), "rid").select(F.col("wa").alias("key"), "shard")
    where = dealt.select(F.explode("anchors").alias("key"), "shard").union(round_common).distinct()
    named = passages.withColumn("pid", F.xxhash64("passage", F.lit("passage")))
    routes = named.select("pid", F.explode("keys").alias("key")).join(where, "key").select("pid", "shard").distinct()
    routed = routes.join(named.select("pid", "passage"), "pid").select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("passage").alias("text"))
    streams = routed.union(held.join(dealt.select("rid", "shard"), "rid").select("shard", F.lit(1), "doc_id", "text")).repartition(3 * shards, "shard").sortWithinPartitions("shard", "kind")
    return _stream(streams, window).union(_whole(rows.join(ids, "rid", "left_anti")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds rid, the same for equal rows and different for different texts: tried by SHA-256, and drawn anew if two texts share one."""
    for seed in range(100):
        found = rows.withColumn("rid", F.xxhash64("doc_id", "text", F.lit(seed)))
        texts = found.where("text is not null").select("rid", F.xxhash64(F.sha2("text", 256)).alias("digest")).groupBy("rid").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        if not texts.where("lo <> hi").take(1):
            return found
    raise ValueError("texts can't be told apart")
