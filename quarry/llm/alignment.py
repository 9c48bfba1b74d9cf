"""Alignment of two tokenizers over a corpus by a dictionary of token groups.

The byte offsets where tokens of both tokenizers end cut a text into groups: `a1,a2|b1` holds the ids of the first
tokenizer's tokens and those of the second's over the same bytes.  Few different groups make up most of a corpus, so

1. a map encodes each text and interns its groups: a document becomes its different groups and how often it has each;
2. the groups of all documents make the dictionary, with the number of documents that hold each;
3. the links (pairs of tokens whose bytes overlap) are expanded once for each group of the dictionary, and each takes the
   group's number of documents.  A pair that several groups of one document link would count that document more than once:
   the map has noted such repeats, and they are taken off;
4. a group's sums over its links go back to the documents by the group's key.  The groups that at least one of
   HOT (document, group) rows in HOT is about are no more than HOT, so they are broadcast; the others are joined by a shuffle.

Edge cases: null and empty texts, and texts that a tokenizer changes (so that its tokens' bytes differ from a blank and the
text), have no tokens: zeros and an empty digest; very long texts are encoded whole; rows with the same doc_id, or with a
null one, are rows of their own, and each counts as a document; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._streams import pieces
from ._words import byte_level

#: At most so many groups are broadcast.
HOT = 20_000
#: Groups, and segments of at most LONGEST characters, that a worker remembers; a table starts anew when it is full.
REMEMBERED, LONGEST = 250_000, 48
#: White space but the blank.
_SIGNS = "\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a text can't be cut at each single blank, and the segments of such a text: blanks and what follows them, up to the next
#: blank that comes right after a character that isn't white space.
_UNEVEN = re.compile(f"\\A |[{_SIGNS} ] | \\Z")
_SEGMENT = re.compile(f" +(?:[^ ]*[{_SIGNS}] +)*[^ ]*(?: +\\Z)?")
#: New segments that are encoded as one text.
JOINED = 256
#: Characters of text that are encoded at once.
CHUNK = 1 << 20


class Alignment(NamedTuple):
    #: A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    documents: DataFrame
    #: The dictionary: group, docs (documents that hold it), n_best and count_sum of its links.
    groups: DataFrame
    #: a, b, docs (documents that hold the pair linked), best (of the pairs of that a).
    pairs: DataFrame


def _cuts_at_blanks(a_path: str, pieces_b: list[str]) -> bool:
    """Whether a's file asks for nothing but the usual split of byte-level BPE, and no piece of b has a blank after something else."""
    with open(a_path, encoding="utf-8") as file:
        asked = json.load(file)
    split = asked.get("pre_tokenizer") or {}
    plain = asked.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return bool(plain) and not any("▁" in p.lstrip("▁") or " " in p for p in pieces_b)


class Encoders:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        pieces_b = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces_b)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Whether both cut before each blank that comes after a character that isn't white space.
        self.apart = _cuts_at_blanks(a_path, pieces_b)
        self._known: dict[str, tuple | None] = {}
        #: The group of each packed key, and the different pairs that a group links.
        self._names: dict[bytes, str] = {}
        self._pairs: dict[str, tuple[int, ...]] = {}

    def _encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of each text (not empty, without its leading blank) by both."""
        coded = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [(a.ids, b) for a, b in zip(coded, self.b.encode(texts, num_threads=1))]

    def _same(self, text: str, ids: tuple[list[int], list[int]]) -> bool:
        raw = b" " + text.encode("utf-8", "replace")
        return b"".join(map(self.a_bytes.__getitem__, ids[0])) == raw == b"".join(map(self.b_bytes.__getitem__, ids[1]))

    def _entries(self, texts: list[str]) -> list[tuple | None]:
        """(number of a's tokens, of b's, groups, groups as one string) of each text; None where a tokenizer changes it."""
        coded = self._encoded(texts) if texts else []
        fit = [self._same(t, ids) for t, ids in zip(texts, coded)]
        listed = iter(self.groups([ids for ids, ok in zip(coded, fit) if ok]))
        return [(len(ids[0]), len(ids[1]), g := next(listed), ";".join(g)) if ok else None for ids, ok in zip(coded, fit)]

    def aligned(self, texts: list[str | None]) -> list[tuple | None]:
        """What _entries gives for each whole text; None for null and empty ones too.

        Where neither tokenizer joins a blank to what comes before it, both cut there, and each different segment is encoded once.
        """
        if not self.apart:
            found = iter(self._entries([t for t in texts if t]))
            return [next(found) if t else None for t in texts]
        cut = [[] if not t else [x[1:] for x in _SEGMENT.findall(" " + t)] if _UNEVEN.search(t) else t.split(" ") for t in texts]
        known = self._known
        new = list({s for found in cut for s in found if s not in known})
        known.update(self._segments(new))
        out = []
        for text, found in zip(texts, cut):
            entries = list(map(known.__getitem__, found))
            if None in entries:
                out += self._entries([text])
            elif entries:
                a, b, groups, joined = zip(*entries)
                out.append((sum(a), sum(b), list(chain.from_iterable(groups)), ";".join(joined)))
            else:
                out.append(None)
        if len(known) > REMEMBERED:
            known.clear()
        else:
            for x in new:
                if len(x) > LONGEST:
                    del known[x]
        return out

    def _segments(self, segments: list[str]) -> dict[str, tuple | None]:
        """What _entries gives for each segment; many are encoded as one text, whose groups end where a segment does."""
        ends_open = [s for s in segments if not s or s[-1].isspace()]
        rest = [s for s in segments if s and not s[-1].isspace()]
        blocks = [rest[at : at + JOINED] for at in range(0, len(rest), JOINED)]
        texts = [" ".join(b) for b in blocks]
        coded = self._encoded(texts) if texts else []
        fit = [self._same(t, ids) for t, ids in zip(texts, coded)]
        apart = ends_open + [s for b, ok in zip(blocks, fit) if not ok for s in b]
        out = dict(zip(apart, self._entries(apart)))
        whole = [s for b, ok in zip(blocks, fit) if ok for s in b]
        if whole:
            listed, ends, a_cut, b_cut = self._cut([ids for ids, ok in zip(coded, fit) if ok])
            goal = np.cumsum(np.fromiter((len(s.encode("utf-8", "replace")) for s in whole), dtype=np.int64, count=len(whole)) + 1)
            at = np.searchsorted(ends, goal)
            if (ends[at] != goal).any():
                raise ValueError("a token goes over a blank after a character that isn't white space")
            n_a, n_b = np.diff(a_cut[at], prepend=0).tolist(), np.diff(b_cut[at], prepend=0).tolist()
            at = (at + 1).tolist()
            for s, a, b, lo, hi in zip(whole, n_a, n_b, [0, *at], at):
                g = listed[lo:hi]
                out[s] = (a, b, g, ";".join(g))
        return out

    def _cut(self, found: list[tuple[list[int], list[int]]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The groups of pairs of id lists, one list after the other, and after each group: bytes, tokens of a, and tokens of b."""
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in found), dtype=np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        place = np.searchsorted(b_ends, a_ends)
        a_cut = np.flatnonzero(b_ends[place] == a_ends) + 1
        b_cut = place[a_cut - 1] + 1
        n_a, n_b = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
        # packed keys, one after the other: the number of a's tokens, these, and b's tokens
        starts = np.concatenate(([0], np.cumsum(n_a + n_b + 1)))
        packed = np.empty(starts[-1], dtype="<i4")
        packed[starts[:-1]] = n_a
        packed[np.arange(len(a)) + np.repeat(starts[:-1] + 1 - (a_cut - n_a), n_a)] = a
        packed[np.arange(len(b)) + np.repeat(starts[:-1] + 1 + n_a - (b_cut - n_b), n_b)] = b
        raw, cuts = packed.tobytes(), (4 * starts).tolist()
        names = self._names
        if len(names) > REMEMBERED:
            names.clear()
            self._pairs.clear()
        keys = [raw[s:e] for s, e in zip(cuts, cuts[1:])]
        for key in set(keys):
            if key not in names:
                n, *ids = np.frombuffer(key, "<i4").tolist()
                names[key] = f"{','.join(map(str, ids[:n]))}|{','.join(map(str, ids[n:]))}"
        return list(map(names.__getitem__, keys)), a_ends[a_cut - 1], a_cut, b_cut

    def groups(self, found: list[tuple[list[int], list[int]]]) -> list[list[str]]:
        """The groups of each pair of id lists, in order."""
        if not found:
            return []
        listed, _, a_cut, _ = self._cut(found)
        per = np.searchsorted(a_cut, np.cumsum([len(x[0]) for x in found]), side="right").tolist()
        return [listed[s:e] for s, e in zip([0, *per], per)]

    def links(self, group: str) -> list[tuple[int, int]]:
        """The pairs of tokens of a group whose bytes overlap, one for each pair of occurrences."""
        left, right = ([int(x) for x in side.split(",")] for side in group.split("|"))
        out, i, j, a_end, b_end = [], 0, 0, int(self.a_size[left[0]]), int(self.b_size[right[0]])
        while True:
            out.append((left[i], right[j]))
            step_a, step_b = a_end <= b_end, b_end <= a_end
            i, j = i + step_a, j + step_b
            if i == len(left) or j == len(right):
                return out
            if step_a:
                a_end += int(self.a_size[left[i]])
            if step_b:
                b_end += int(self.b_size[right[j]])

    def repeats(self, groups) -> list[int]:
        """The pairs (a * 2**32 + b) that several of a document's different groups link, once for each group beyond the first."""
        known = self._pairs
        for g in groups:
            if g not in known:
                known[g] = tuple({a << 32 | b for a, b in self.links(g)})
        flat = list(chain.from_iterable(map(known.__getitem__, groups)))
        if len(set(flat)) == len(flat):
            return []
        return [p for p, n in Counter(flat).items() for _ in range(n - 1)]


_encoders: dict[tuple[str, str], Encoders] = {}


def encoders(a_path: str, b_path: str) -> Encoders:
    """One pair of tokenizers in a worker process."""
    if (a_path, b_path) not in _encoders:
        _encoders[a_path, b_path] = Encoders(a_path, b_path)
    return _encoders[a_path, b_path]


def _chunks(batches):
    """(batch, texts) with about CHUNK characters of text at most, or one text."""
    for batch in pieces(batches, 500):
        texts, lo, size = batch.column(2).to_pylist(), 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= CHUNK or k + 1 == len(texts):
                yield batch.slice(lo, k + 1 - lo), texts[lo : k + 1]
                lo, size = k + 1, 0


def grouped(documents: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256, its different groups, how
    often it has each (times), and the repeats of pairs."""
    chosen = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "times", "repeats"]

    def run(batches):
        own = encoders(a_path, b_path)
        for batch, texts in _chunks(batches):
            n_a, n_b, n_groups, digest, groups, times, repeats = ([] for _ in range(7))
            for found in own.aligned(texts):
                a, b, each, joined = found or (0, 0, (), "")
                counted = Counter(each)
                n_a.append(a)
                n_b.append(b)
                n_groups.append(len(each))
                digest.append(hashlib.sha256(joined.encode()).hexdigest() if found else "")
                groups.append(list(counted))
                times.append(list(counted.values()))
                repeats.append(own.repeats(counted))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(batch.columns[:2] + [pa.array(v, k) for v, k in zip((n_a, n_b, n_groups, digest, groups, times, repeats), kinds)], names)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<string>, times array<long>, repeats array<long>"
    return chosen.mapInArrow(run, schema)


def _expanded(dictionary: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each group and pair that it links: group, docs, a, b and how often it links the pair."""

    def run(batches):
        own = encoders(a_path, b_path)
        for batch in pieces(batches, 5000):
            found = [Counter(own.links(g)) for g in batch.column(0).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            flat = [p for x in found for p in x]
            columns = [pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.int64()), pa.array([n for x in found for n in x.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns], ["group", "docs", "a", "b", "times"])

    return dictionary.mapInArrow(run, "group string, docs long, a long, b long, times long")


def align(documents: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> Alignment:
    """Align a byte-level BPE of the tokenizers library (a) with a sentencepiece model (b) over all documents."""
    own = written(grouped(documents, a_path, b_path, text, doc_id), "alignment-documents")
    dictionary = written(own.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("docs")), "alignment-groups")
    links = written(_expanded(dictionary, a_path, b_path), "alignment-links")

    repeated = own.select(F.explode("repeats").alias("p")).select(F.shiftright("p", 32).alias("a"), F.col("p").bitwiseAND((1 << 32) - 1).alias("b"), F.lit(-1).cast("long").alias("docs"))
    counted = written(links.select("a", "b", "docs").unionAll(repeated).groupBy("a", "b").agg(F.sum("docs").alias("docs")), "alignment-pairs")
    # a row for each id of the first vocabulary at most
    best = counted.groupBy("a").agg(F.max("docs").alias("best"))
    pairs = counted.join(F.broadcast(best), "a")

    at = links.select("group", F.col("docs").alias("group_docs"), "a", "b", "times").join(pairs, ["a", "b"])
    sums = (F.sum(F.col("times") * (F.col("docs") == F.col("best")).cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    groups = written(at.groupBy("group", "group_docs").agg(*sums).withColumnRenamed("group_docs", "docs"), "alignment-sums")

    total = groups.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") * HOT > total  # so fewer than HOT groups
    few = groups.where(hot).select("group", "n_best", "count_sum")
    rows = own.select("row", F.explode(F.arrays_zip("groups", "times")).alias("g")).select("row", F.col("g.groups").alias("group"), F.col("g.times").alias("n"))
    each = ("row", (F.col("n") * F.col("n_best")).alias("n_best"), (F.col("n") * F.col("count_sum")).alias("count_sum"))
    near = rows.join(F.broadcast(few), "group").select(*each)
    far = rows.join(F.broadcast(few.select("group")), "group", "left_anti").join(groups.where(~hot).select("group", "n_best", "count_sum"), "group").select(*each)
    summed = near.unionAll(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    result = own.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(summed, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups",
        # within a group no other offset is common, so n tokens against m make n + m - 1 links
        (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
    return Alignment(result, groups, pairs)
