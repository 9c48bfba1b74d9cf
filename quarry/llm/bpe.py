"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is merged on its own, lowest rank first and leftmost first among
equal ranks.  The queue has one bucket for each merge rank, holding positions of a linked list of
tokens; a two-level bitmap over the ranks finds the first bucket that is not empty by
find-first-set.  A merge only appends the new pairs of its neighbours; entries whose pair has
changed since are stale and are skipped when they come up, so a pre-token of n bytes takes
O(n) queue entries however long it is.  Many pre-tokens share one queue: their lists are not linked.

Edge cases: null and empty texts give no ids; very long texts and pre-tokens are encoded whole;
lone surrogates become U+FFFD as in UTF-8 encoding with replacement; repeated rows are encoded like
any other; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._streams import pieces

#: Unicode White_Space, which separates segments; no match of the split pattern crosses from a
#: character that is not white space to one that is.
_SPACE = "\t-\r \x85\xa0  -     　"
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Segments and pre-tokens of at most LONGEST characters that a worker remembers; the table starts anew when it is full.
REMEMBERED, LONGEST = 300_000, 48
#: Places of the table of hashes that came up before.
SEEN = 1 << 22
#: Characters of text whose new pre-tokens share one queue.
CHUNK = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class RankQueue:
    """Buckets of positions by rank; pop() takes the whole first bucket."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * ((ranks >> 8) + 1)
        self.high = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.low[rank >> 8] |= 1 << (rank & 255)
            self.high |= 1 << (rank >> 8)
        bucket.append(position)

    def extend(self, rank: int, positions: list[int]) -> None:
        if positions:
            self.push(rank, positions[0])
            self.buckets[rank].extend(positions[1:])

    def pop(self) -> tuple[int, list[int]]:
        group = (self.high & -self.high).bit_length() - 1
        bits = self.low[group]
        bit = bits & -bits
        rank = (group << 8) | (bit.bit_length() - 1)
        bits ^= bit
        self.low[group] = bits
        if not bits:
            self.high ^= 1 << group
        found, self.buckets[rank] = self.buckets[rank], []
        return rank, found


class Codec:
    """Encoder and decoder for one table of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(k) for k in range(size)]
        self.numbers = list(range(size))
        self.first = [ranks[bytes([b])] for b in range(256)]
        #: Rank of what a pair merges to, by its left token and then its right one, and the other way round.
        self.starting: dict[int, dict[int, int]] = {}
        self.ending: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.starting.setdefault(left, {})[right] = rank
                    self.ending.setdefault(right, {})[left] = rank
        self._byte_pairs = np.full((256, 256), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self._byte_pairs[a, b] = self.starting.get(self.first[a], {}).get(self.first[b], -1)
        self._queue = RankQueue(size)
        #: Ids of segments and pre-tokens that came up in two chunks, and a bit for each hash that came up in one.
        self._known: dict[str, tuple[int, ...]] = {}
        self._seen = bytearray(SEEN)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece, all through one queue."""
        out: list = [None] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = (self.numbers[rank],)
            elif piece:
                rest.append(k)
            else:
                out[k] = ()
        if not rest:
            return out
        data = np.frombuffer(b"".join(pieces[k] for k in rest), dtype=np.uint8)
        ends = np.cumsum([len(pieces[k]) for k in rest])
        n = len(data)
        ranked = np.full(n, -1, dtype=np.int64)
        ranked[:-1] = self._byte_pairs[data[:-1], data[1:]]
        ranked[ends - 1] = -1
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.concatenate(([0], ends[:-1]))] = -1
        queue = self._queue
        order = np.argsort(ranked, kind="stable")
        order = order[np.searchsorted(ranked[order], 0) :]
        cuts = np.flatnonzero(np.diff(ranked[order], prepend=-2)).tolist() + [len(order)]
        order_list = order.tolist()
        pair, nxt, prv = ranked.tolist(), after.tolist(), before.tolist()
        token = np.array(self.first)[data].tolist()
        for a, b in zip(cuts, cuts[1:]):
            queue.extend(pair[order_list[a]], order_list[a:b])
        buckets, low = queue.buckets, queue.low
        while queue.high:
            rank, found = queue.pop()
            if len(found) > 1:
                found.sort()
            left_of, right_of = self.ending.get(rank), self.starting.get(rank)
            for done, at in enumerate(found):
                if pair[at] != rank:
                    continue  # stale
                right = nxt[at]
                nxt[at] = far = nxt[right]
                token[at] = rank
                pair[right] = pair[at] = -1
                early = False
                if far >= 0:
                    prv[far] = at
                    if right_of and (new := right_of.get(token[far])) is not None:
                        pair[at] = new
                        bucket = buckets[new]
                        if not bucket:
                            low[new >> 8] |= 1 << (new & 255)
                            queue.high |= 1 << (new >> 8)
                        bucket.append(at)
                        early = new < rank
                left = prv[at]
                if left >= 0:
                    if left_of and (new := left_of.get(token[left])) is not None:
                        pair[left] = new
                        bucket = buckets[new]
                        if not bucket:
                            low[new >> 8] |= 1 << (new & 255)
                            queue.high |= 1 << (new >> 8)
                        bucket.append(left)
                        early |= new < rank
                    else:
                        pair[left] = -1
                if early:  # a lower rank comes first now
                    queue.extend(rank, found[done + 1 :])
                    break
        numbers = self.numbers
        for k, end in zip(rest, ends.tolist()):
            at, ids = end - len(pieces[k]), []
            while at >= 0:
                ids.append(numbers[token[at]])
                at = nxt[at]
            out[k] = tuple(ids)
        return out

    def _learn(self, segments: set[str]) -> list[str]:
        """Remember the ids of segments that are not known yet, and of their pre-tokens; returns all that is new."""
        known, findall = self._known, self.pattern.findall
        split = {s: findall(s) for s in segments}
        new = list({p for found in split.values() for p in found if p not in known})
        known.update(zip(new, self.merge([p.encode("utf-8", "replace") for p in new])))
        for segment, found in split.items():
            if len(found) != 1:
                known[segment] = tuple(chain.from_iterable(map(known.__getitem__, found)))
                new.append(segment)
        return new

    def _forget(self, new: list[str]) -> None:
        """Of what a chunk brought only what an earlier chunk had as well stays, and short strings only."""
        known, seen = self._known, self._seen
        if len(known) - len(new) > REMEMBERED:
            known.clear()
            return
        for s in new:
            k = hash(s) % SEEN
            if not seen[k]:
                seen[k] = 1
                known.pop(s, None)
            elif len(s) > LONGEST:
                known.pop(s, None)

    def encode_all(self, texts: list[str | None]):
        """The ids of each text, in order."""
        k = 0
        while k < len(texts):
            chunk, size = [], 0
            while k < len(texts) and (not chunk or size < CHUNK):
                chunk.append(_SEGMENT.findall(texts[k]) if texts[k] else [])
                size += len(texts[k] or "")
                k += 1
            known = self._known
            new = self._learn({s for found in chunk for s in found if s not in known})
            for found in chunk:
                yield list(chain.from_iterable(map(known.__getitem__, found)))
            self._forget(new)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each table of ranks in a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with ids (array<int>) of each row; a map over the rows, no shuffle."""
    chosen = documents.select(*keep, F.col(text).alias("__text"))
    schema = chosen.drop("__text").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        own = codec(path, pattern)
        for batch in pieces(batches):
            ids = [np.array(x, dtype=np.int32) for x in own.encode_all(batch.column(len(keep)).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + [pa.array(ids, pa.list_(pa.int32()))], schema.names)

    return chosen.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with decoded (binary) of each row's ids; null ids decode to nothing."""
    chosen = encoded.select(*keep, F.col(ids).alias("__ids"))
    schema = chosen.drop("__ids").schema.add("decoded", "binary")

    def run(batches):
        own = codec(path, pattern)
        for batch in pieces(batches):
            found = [own.decode_bytes(x or []) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + [pa.array(found, pa.binary())], schema.names)

    return chosen.mapInArrow(run, schema)


def round_trip(documents: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each row: encodes, then decodes those ids.

    Both halves run in one pass inside the task, so that the ids needn't be moved in between.
    """
    chosen = documents.select(*keep, F.col(text).alias("__text"))
    schema = chosen.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        own = codec(path, pattern)
        for batch in pieces(batches):
            count, coded, decoded = [], [], []
            for ids in own.encode_all(batch.column(len(keep)).to_pylist()):
                count.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            columns = [pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + columns, schema.names)

    return chosen.mapInArrow(run, schema)
