"""Token-id output as sorted-string-table shards.

A shard file holds documents in ascending key order::

    magic | data blocks | block index | Bloom filter | footer | magic

A data block (about 64 KB before compression by zstd, with a CRC-32) is a run
of entries: shared key length, own key length, value length (varints), own key
bytes, value. Every 16th entry is a restart point that shares nothing; the
restart offsets end the block, so a lookup is: Bloom filter, binary search in
the sparse block index (last key of each block), binary search over restarts,
at most 16 entries. Keys are 9 bytes that sort as the ids do, nulls first.
Values are token ids, little-endian, 2 bytes each where the vocabulary allows.

The table is dealt into shards by ranges of the id (and of the text's hash, so
one id may fill several), so ascending shards hold ascending ids. A task writes
a shard under a name of its own and names it in its result, so a lost or
doubled task leaves only files that no manifest lists. The folder is one that
pyarrow opens: local, hdfs, s3 (also as s3a), gs or abfss.

Defined results: a null text counts as empty (the end id alone); rows of one
id are all kept, ordered by the XXH64 of their text; texts of any length are
encoded whole; an empty table gives no shards; other columns are not stored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, materialize, new_path, part_count, worker_cache
from .bpe import byte_letters

#: Bytes of input for a shard.
SHARD = 1 << 26
MAGIC = b"QLSST001"
BLOCK, RESTART, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 16, 10, 7
# Fixed value: how byte-level vocabularies cut text into pieces, in the form that does not go back over long runs.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
FOOTER = struct.Struct("<QQQQQQBxxxxxxx")  # index offset and size, Bloom offset and size, entries, tokens, bytes an id


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


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


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes entries that come in ascending key order to an open stream."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self.entries = self.tokens = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.n % RESTART:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.hashes or self.hashes[-1] != key:
            self.hashes.append(key)
        self.n, self.last = self.n + 1, key
        self.entries, self.tokens = self.entries + 1, self.tokens + len(value) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            data = self.pack(raw)
            self.index.append((self.last, self.at, len(data)))
            self._put(data + struct.pack("<I", zlib.crc32(data)))
            self.block, self.restarts, self.n = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = bytearray((bits + 7) // 8)
        for key in self.hashes:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        at_index = self.at
        self._put(index)
        at_bloom = self.at
        self._put(struct.pack("<Q", bits) + bytes(bloom))
        self._put(FOOTER.pack(at_index, len(index), at_bloom, self.at - at_bloom, self.entries, self.tokens, self.width) + MAGIC)


class Reader:
    """Reads a shard from a seekable file: ``scan()`` in order, or ``get(id)``."""

    def __init__(self, file):
        self.file = file
        tail = FOOTER.size + len(MAGIC)
        end = file.seek(0, 2)
        data = self._read(end - tail, tail)
        if data[FOOTER.size :] != MAGIC:
            raise ValueError("not a whole shard file")
        a, n, self.bloom_at, self.bloom_size, self.entries, self.tokens, self.width = FOOTER.unpack(data[: FOOTER.size])
        raw, at, self.index = self._read(a, n), 0, []
        while at < len(raw):
            size, at = _read_varint(raw, at)
            key, at = raw[at : at + size], at + size
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        self.bloom = None
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        _, at, n = self.index[i]
        data = self._read(at, n + 4)
        if zlib.crc32(data[:n]) != struct.unpack("<I", data[n:])[0]:
            raise ValueError("a block is damaged")
        raw = self.unpack(data[:n])
        k = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 * (k + 1)
        return raw, list(struct.unpack(f"<{k}I", raw[end:-4])), end

    def _entries(self, raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            yield key, raw[at + own : at + own + size]
            at += own + size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            raw, _, end = self._block(i)
            for key, value in self._entries(raw, 0, end):
                yield id_of(key), self.ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the documents of this id."""
        key = key_of(doc_id)
        if self.bloom is None:
            data = self._read(self.bloom_at, self.bloom_size)
            self.bloom = struct.unpack("<Q", data[:8])[0], data[8:]
        bits, bloom = self.bloom
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits)):
            return []
        found = []
        for i in range(bisect_left(self.index, (key,)), len(self.index)):
            raw, restarts, end = self._block(i)
            lo, hi = 0, len(restarts) - 1  # the last restart whose key is below ours
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if next(self._entries(raw, restarts[mid], end))[0] < key else (lo, mid - 1)
            for k, value in self._entries(raw, restarts[lo], end):
                if k > key:
                    return found
                if k == key:
                    found.append(self.ids(value))
        return found


class Encoder:
    """Ids as the tokenizers library gives them, packed as little-endian integers.

    Where ``proven`` holds, tiktoken's merge loop, several times as fast, gives
    the same ids; the library gets texts with the string of a special token.
    """

    def __init__(self, file: bytes, fast: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode())
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.type = "<u2" if size <= 1 << 16 else "<u4"
        self.special = [x["content"] for x in json.loads(file)["added_tokens"]]
        self.fast = tiktoken.Encoding("shards", pat_str=PIECES, mergeable_ranks=_ranks(json.loads(file)), special_tokens={}) if fast else None

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not any(x in text for x in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.type).tobytes()
            except ValueError:  # white space so long that its expression engine gives up
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()


def _ranks(spec: dict) -> dict[bytes, int]:
    """Bytes to id of the single bytes and of what the merges make."""
    byte = {c: b for b, c in enumerate(byte_letters())}
    ids = spec["model"]["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    return {bytes(byte[c] for c in t): ids[t] for t in [*byte, *merged]}


def proven(file: bytes) -> bool:
    """Whether merging by least id of the merged bytes gives the library's ids on any text.

    The library merges listed pairs only, tiktoken any two tokens whose bytes
    are a token. Both take the least first, and a merge makes later ones
    possible only (parts have lower ids than the whole). So they could differ
    only where a token's bytes are left as another pair than the listed one;
    what is left of these bytes does not depend on what stands around them,
    and it is the listed pair if the library encodes them to the one token.
    """
    from tokenizers import Tokenizer

    spec = json.loads(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if model["type"] != "BPE" or any((model.get(k) or v) != v for k, v in plain.items()):
        return False
    ids, letters = model["vocab"], byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [ids.get(a + b, -1) for a, b in pairs]
    if any(c not in ids for c in letters) or any(x <= y for x, y in zip(made, [max(ids[c] for c in letters), *made], strict=False)):
        return False
    if any(max(ids[a], ids[b]) >= i for (a, b), i in zip(pairs, made, strict=True)):
        return False
    alone = Tokenizer.from_str(json.dumps({**spec, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
    return all(e.ids == [i] for e, i in zip(alone.encode_batch_fast([a + b for a, b in pairs], add_special_tokens=False), made, strict=True))


def encoder(file: bytes, fast: bool) -> Encoder:
    """One a worker process and file."""
    return worker_cache(("shards", xxhash.xxh3_128_digest(file)), lambda: Encoder(file, fast))


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; Hadoop's names of the S3 scheme are one to pyarrow."""
    path = re.sub("^s3[an]:", "s3:", path)
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def write(df: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode ``df`` into shards below ``folder``; the manifest (shard, path, entries, tokens) is the result, one row a shard."""
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        data = f.read()
    file, fast = spark.sparkContext.broadcast(data), proven(data)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = shards or part_count(docs, SHARD)
    # Ranges by id; rows of one id are told apart by their text, and equal rows by where they stood, so no id is too large for a shard.
    docs = docs.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("mark"), F.col("row")]
    dealt = docs.repartitionByRange(shards, *order).sortWithinPartitions(order[0], "mark", "text").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file.value, fast)
        store, top = _store(folder)
        end = np.array([end_id], enc.type).tobytes()
        shard = out = writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                shard = batch["shard"][0].as_py()
                name = f"{top}/{shard:06d}-{uuid.uuid4().hex}.sst"
                out = store.open_output_stream(name + ".part")
                writer = Writer(out, int(enc.type[-1]))
            for i, text in zip(batch["id"], batch["text"], strict=True):
                writer.add(key_of(i.as_py()), enc.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            out.close()
            store.move(name + ".part", name)
            row = [pa.array([x], t) for x, t in ((shard, pa.int32()), (name, pa.string()), (writer.entries, pa.int64()), (writer.tokens, pa.int64()))]
            yield pa.RecordBatch.from_arrays(row, names=["shard", "path", "entries", "tokens"])

    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    made = map_arrow(dealt.select("id", "text", "shard"), run, "shard int, path string, entries long, tokens long")
    return materialize(made, "manifest")


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the shards, read back: (id, start, n_tokens, ids_crc32). ``start``: ids of all documents before.

    The driver sees the manifest only, a row a shard.
    """
    rows, start = [], 0
    for i, r in enumerate(sorted(manifest.collect(), key=lambda r: r["shard"])):
        rows.append((i, r["path"], start))
        start += r["tokens"]
    files = spark.createDataFrame(rows, "i int, path string, start long").repartitionById(max(1, len(rows)), F.col("i")).select("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    for part in _chunks(Reader(f).scan(), 5000):
                        ids, starts, ns, crcs = [], [], [], []
                        for i, tokens in part:
                            ids.append(i)
                            starts.append(start)
                            ns.append(len(tokens))
                            crcs.append(zlib.crc32(tokens.tobytes()))
                            start += len(tokens)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ns, crcs)], names=["id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(files, run, "id long, start long, n_tokens long, ids_crc32 long")


def _chunks(rows: Iterable, size: int) -> Iterator[list]:
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def encoded(df: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards to a fresh folder of the shared ones and read them back."""
    spark = df.sparkSession
    folder = new_path(spark, "sst")
    manifest = write(df, folder, vocabulary, end_id, id_col, text_col)
    return read(spark, manifest, folder).withColumnRenamed("id", id_col)
