"""Token ids as sorted-string-table shards, keyed by document.

A shard holds the documents of one range of doc_ids in ascending order.  File layout, all numbers
little-endian unless said otherwise:

    blocks   zstd frames; inside, for each document: varint shared-prefix length, varint suffix
             length, suffix of the key, varint number of ids, the ids (2 or 4 bytes each, as the
             footer says).  The first key of a block is whole.  Keys are 9 bytes: 0 for a null
             doc_id, else 1, then doc_id with its sign bit turned, big-endian.
    index    for each block: first key (9 bytes), offset (8), length (4)
    bloom    bits of a Bloom filter over the keys
    footer   72 bytes: index offset, index length, Bloom offset, Bloom length, Bloom hashes,
             documents, ids, bytes of an id, magic

Edge cases: null and empty texts have only the end id; documents with the same doc_id are separate
records that stand together, in order of their texts; documents with a null doc_id come first; an
empty table writes no shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh_path, written
from ._words import byte_level

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<8Q8s")
ENTRY = struct.Struct("<9sQI")
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
#: Characters that lower case and composition leave single: Latin-1 without its controls and soft hyphen.
_LATIN = re.compile("[!-~¡-¬®-ÿ]+")
#: What is in a text that isn't all of such characters and blanks, tabs and line ends.
_BEYOND = re.compile("[^\t\n\r -~¡-¬®-ÿ]")
#: Words of at most LONGEST characters that a worker remembers; the table starts anew when it is full.
REMEMBERED, LONGEST = 250_000, 48


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [((a + k * b) ^ (k * k * 0x9E37)) % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; records must come in ascending order of their keys."""

    def __init__(self, sink, id_bytes: int):
        self.sink, self.id_bytes = sink, id_bytes
        self.at, self.index, self.keys, self.ids = 0, [], [], 0
        self._pack = zstandard.ZstdCompressor(level=1)
        self._block, self._size, self._first, self._last = [], 0, b"", b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        shared = len(os.path.commonprefix([key, self._last])) if self._block else 0
        if not self._block:
            self._first = key
        value = ids.astype("<u2" if self.id_bytes == 2 else "<u4").tobytes()
        record = _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids)) + value
        self._block.append(record)
        self._size += len(record)
        self._last = key
        self.keys.append(key)
        self.ids += len(ids)
        if self._size >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.sink.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self._block:
            self.index.append((self._first, *self._put(self._pack.compress(b"".join(self._block)))))
            self._block, self._size = [], 0

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(ENTRY.pack(*x) for x in self.index))
        bits = max(64, -(-len(self.keys) * BLOOM_BITS_PER_KEY // 8) * 8)
        filled = bytearray(bits // 8)
        for key in self.keys:
            for place in _bloom_places(key, bits):
                filled[place >> 3] |= 1 << (place & 7)
        bloom = self._put(bytes(filled))
        self._put(FOOTER.pack(*index, *bloom, BLOOM_HASHES, len(self.keys), self.ids, self.id_bytes, MAGIC))


class Reader:
    """Reads one shard: everything in order, or one document by its id."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        *numbers, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token-id shard")
        at, length, self._bloom_at, self._bloom_length, _, self.documents, self.ids, self.id_bytes = numbers
        self.index = list(ENTRY.iter_unpack(self._read(at, length)))
        self._bloom = None

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _records(self, block: int):
        _, at, length = self.index[block]
        data = zstandard.ZstdDecompressor().decompressobj().decompress(self._read(at, length))
        key, at = b"", 0
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            n, at = _read_varint(data, at)
            yield key, np.frombuffer(data, "<u2" if self.id_bytes == 2 else "<u4", n, at)
            at += n * self.id_bytes

    def __iter__(self):
        for block in range(len(self.index)):
            for key, ids in self._records(block):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of the documents with this doc_id: Bloom filter, index, then their blocks."""
        key = key_of(doc_id)
        if self._bloom is None:
            self._bloom = self._read(self._bloom_at, self._bloom_length)
        if not self.index or any(not self._bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, len(self._bloom) * 8)):
            return []
        firsts = [first for first, _, _ in self.index]
        blocks = range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))
        return [ids for block in blocks for found, ids in self._records(block) if found == key]

    def close(self) -> None:
        self.file.close()


def latin_splitter(path: str) -> re.Pattern | None:
    """The pattern of a tokenizer file's pre-tokens, for texts of Latin-1 in lower case; None if the file asks for more.

    Such texts are in NFC, and lower case is one character for one, so after these steps only the split is left.
    """
    with open(path, encoding="utf-8") as file:
        asked = json.load(file)
    steps = (asked.get("normalizer") or {}).get("normalizers", [])
    split, *rest = (asked.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    known = [(n.get("type"), n.get("pattern"), n.get("content")) for n in steps] == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
    known &= split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    known &= [(r.get("type"), r.get("use_regex"), r.get("add_prefix_space")) for r in rest] == [("ByteLevel", False, False)]
    model = asked["model"]
    if not known or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    pattern = split["pattern"].get("Regex", "")
    for kind in "LN":
        pattern = pattern.replace(rf"\p{{{kind}}}", "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind))
    return None if r"\p" in pattern else re.compile(pattern)


class WordCodec:
    """The tokenizers library's ids of whole texts, each different word encoded once.

    Its vocabulary drops white space and never joins across it, so a text's ids are those of its words.  Texts of Latin-1 are taken
    apart into pre-tokens by the pattern of the tokenizer's file, and new ones go to the library's merges.  Many new words of other
    texts go to the library as one text, parted by a special token there.
    Texts that hold the string of such a token go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        parting = [(t.content, k) for k, t in added.items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.between, self.between_id = parting[0] if parting else (None, None)
        self.split = latin_splitter(path)
        #: The vocabulary's character for each byte.
        self._char = {b: c for c, b in byte_level().items()}
        self._words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> list[bytes]:
        """The library's ids of each word."""
        if self.between is None:
            return self._library(words)
        out = []
        for raw in self._library([self.between.join(words[at : at + 256]) for at in range(0, len(words), 256)]):
            cuts = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.between_id)).tolist()
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])]
        return out

    def _learn_parts(self, parts: list[str]) -> list[str]:
        """Remember the ids of pre-tokens that are not known yet: the library's merges, without the steps before them."""
        merge, known = self.tokenizer.model.tokenize, self._words
        for p in parts:
            known[p] = array("I", [t.id for t in merge(p if p.isascii() else "".join(map(self._char.__getitem__, p.encode())))]).tobytes()
        return parts

    def _learn(self, words: set[str]) -> list[str]:
        """Remember the ids of words that are not known yet; returns all that is new.

        Words of Latin-1 go to the library in lower case, as it would make them, and without a full stop or comma after their
        last letter, which it takes apart.
        """
        known = self._words
        parts = {}
        for w in words:
            base = w.lower() if _LATIN.fullmatch(w) else w
            if any(t in base for t in self.added):  # of another case, so no such token
                base = w
            parts[w] = (base[:-1], base[-1]) if base is not w and base[-2:-1].isalpha() and base[-1] in ".," else (base, "")
        new = list({p for both in parts.values() for p in both if p not in known})
        known.update(zip(new, self._apart(new)))
        for w, (base, mark) in parts.items():
            if w not in known:
                known[w] = known[base] + known[mark]
                new.append(w)
        return new

    def _forget(self, new: list[str]) -> None:
        """Short strings stay until the table is full."""
        if len(self._words) > REMEMBERED:
            self._words.clear()
            return
        for w in new:
            if len(w) > LONGEST:
                self._words.pop(w, None)

    def encode_all(self, texts: list[str | None], chunk: int = 1 << 20):
        """The ids of each text as little-endian 32-bit bytes."""
        k = 0
        while k < len(texts):
            held, simple, mixed, size = [], [], [], 0
            while k < len(texts) and (not held or size < chunk):
                text = texts[k] or ""
                if any(t in text for t in self.added):
                    held.append(text)
                elif self.split and not _BEYOND.search(text):
                    held.append(self.split.findall(text.lower()))
                    simple.append(held[-1])
                else:
                    held.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
                    mixed.append(held[-1])
                size += len(text)
                k += 1
            known = self._words
            new = self._learn_parts(list({p for found in simple for p in found if p not in known}))
            new += self._learn({w for found in mixed for w in found if w not in known})
            for found in held:
                yield b"".join(map(known.__getitem__, found)) if isinstance(found, list) else self._library([found])[0]
            self._forget(new)


_codecs: dict[str, WordCodec] = {}


def word_codec(path: str) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def write(documents: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write shards; returns their manifest (path, first_id, n_docs, n_ids).

    One range shuffle of the texts sorts them by doc_id; each task then streams its range into one
    file, which gets its name only when it is complete, so a task that runs again replaces it.
    The folder is any that pyarrow's file systems reach from every executor.
    """
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    ordered = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        own = word_codec(tokenizer_path)
        width = 2 if max(own.size - 1, end_id) < 1 << 16 else 4
        end = struct.pack("<I", end_id)
        writer = sink = None
        first = None
        system, base = fs.FileSystem.from_uri(folder)
        name = f"{base}/shard-{TaskContext.get().partitionId():06d}.sst"
        part = f"{name}.{uuid.uuid4().hex}"
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if ids and writer is None:
                first = ids[0]
                system.create_dir(base, recursive=True)
                sink = system.open_output_stream(part)
                writer = Writer(sink, width)
            for doc, raw in zip(ids, own.encode_all(batch.column(1).to_pylist())):
                writer.add(doc, np.frombuffer(raw + end, "<u4"))
        if writer is not None:
            writer.close()
            sink.close()
            system.move(part, name)
            scheme = folder.split("://")[0] + "://" if "://" in folder else ""
            place = scheme + name if scheme == "file://" or not scheme else f"{folder}/{name.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_arrays(
                [pa.array([place]), pa.array([first], pa.int64()), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.ids], pa.int64())], ["path", "first_id", "n_docs", "n_ids"]
            )

    return written(ordered.mapInArrow(run, "path string, first_id long, n_docs long, n_ids long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards.

    start is the number of ids in all shards and documents before it.  The running sum over the
    manifest has one row for each file.
    """
    order = Window.orderBy(F.asc_nulls_first("first_id"), "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path)
                rows: list[tuple] = []
                for doc, ids in reader:
                    rows.append((doc, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    base += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                reader.close()
                yield _rows(rows)

    return placed.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, doc_id: int) -> list[list[int]]:
    """The ids of one document: the manifest gives the shard, the shard's index the block."""
    rows = manifest.where((F.col("first_id") <= doc_id) | F.col("first_id").isNull()).orderBy(F.desc_nulls_last("first_id")).limit(1).collect()
    found = []
    for row in rows:
        reader = Reader(row.path)
        found += [ids.tolist() for ids in reader.get(doc_id)]
        reader.close()
    return found
