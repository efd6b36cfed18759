"""Token ids in sorted-string-table shards.

Documents are dealt by ranges of (doc_id, hash of the text), encoded in key order and streamed into one table a task:

    header   8 bytes magic
    blocks   zstd-compressed; entries of (shared key bytes, other key bytes, value bytes, key suffix, value), lengths as
             varints; the first key of a block is whole
    bloom    bits, 10 for each key, 7 probes by double hashing
    index    for each block: first key, offset, size, entries
    footer   64 bytes: offsets and sizes of bloom and index, documents, tokens, id width, crc32 of bloom and index, magic

A key is a zero byte for a null identifier or else a one byte and the identifier as eight big-endian bytes with its sign
bit flipped, so byte order is ascending doc_id, nulls first. A value is the ids, little-endian, two bytes each where the
vocabulary allows, else four. Repeated identifiers are kept as repeated keys, in the order of their texts' hashes.

Shards are written under a temporary name and renamed, so a task that is run again leaves one whole shard.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, eights, hash_spans, lane, new_folder, prepare, settle, slices, utf8

MAGIC = b"LLSST\x01\x00\x00"
FOOTER = struct.Struct("<QQQQQQII8s")
#: Raw bytes after which a block is closed, and text bytes that a shard is meant to hold.
BLOCK_BYTES, SHARD_BYTES = 1 << 18, 32 << 20
#: Pieces whose ids a worker remembers (about 40 bytes each), bytes of the longest of them, and text bytes that are encoded at once.
REMEMBERED, SHORT, PIECE_BYTES = 1_000_000, 32, 1 << 19
#: Shards that a task reads back, where there are more than a few for each core.
READ_SHARDS = 8
#: The id that ends every document.
END = 0


# --- encoding -------------------------------------------------------------------------------------------------------


class Encoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, and remembers the ids of pieces.

    The byte-level pre-tokeniser never joins across a place where a non-space is followed by one space and a non-space,
    nor around a single line feed between non-spaces, so the ids of the pieces between such places can be joined. A
    tokenizer of another make encodes whole texts, and so are texts with any other white space, or with one of the
    tokenizer's added tokens. Pieces of up to ``SHORT`` bytes are looked up by hash and compared byte for byte; longer
    ones, and those whose hash belongs to another piece, are told apart by their bytes and not remembered. Unknown ones are
    encoded many at a time, one after the other, and told apart by the byte lengths of their ids.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.in_pieces = _cuts_at_spaces(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character a byte
        for token, k in vocabulary.items():
            self.lengths[k] = len(token)
        self.forget()

    def forget(self) -> None:
        # sorted hashes of pieces with place and size of their bytes, start and count of their ids: many, and those since the last merge
        self.main, self.recent = _NONE, _NONE
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0
        self.bytes, self.filled = np.zeros(1 << 16, np.uint8), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray) -> int:
        """Where ``ids`` now stand."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), self.used), self.dtype)])
        self.ids[at : self.used] = ids
        return at

    def _split(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces: start and count of the ids of each. Those that begin with a space follow one another, the others a line feed each."""
        starts, counts = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        spaced = data[start] == 0x20
        for mine, extra in ((np.flatnonzero(spaced), 0), (np.flatnonzero(~spaced), 1)):
            for lo in range(0, len(mine), 4096):
                some = mine[lo : lo + 4096]
                size = end[some] - start[some] + extra
                stop = np.cumsum(size)
                text = np.full(int(stop[-1]), 0x0A, np.uint8)
                inner = np.repeat(start[some] - extra - (stop - size), size) + np.arange(len(text))
                take = np.ones(len(text), bool)
                if extra:
                    take[stop - size] = False
                text[take] = data[inner[take]]
                ids = self._whole([text.tobytes().decode()])[0]
                at = np.cumsum(self.lengths[ids])
                to = np.searchsorted(at, stop)
                first = np.r_[0, to[:-1] + 1] + extra
                if len(at) and at[-1] == stop[-1] and (at[to] == stop).all() and (not extra or (self.lengths[ids[first - 1]] == 1).all()):
                    starts[some], counts[some] = self._keep(ids) + first, to + 1 - first
                else:
                    for k, own in zip(some.tolist(), self._whole([data[start[k] : end[k]].tobytes().decode() for k in some.tolist()]), strict=True):
                        starts[k], counts[k] = self._keep(own), len(own)
        return starts, counts

    def _learn(self, data: np.ndarray, hashed: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        starts, counts = self._split(data, start, end)
        size = end - start
        stop = np.cumsum(size)
        raw = data[np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]))]
        at, self.filled = self.filled, self.filled + len(raw)
        if self.filled + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), self.filled), np.uint8)])
        self.bytes[at : self.filled] = raw
        self.recent = _merged(self.recent, (hashed, (at + stop - size).astype(np.int32), size.astype(np.int32), starts, counts))
        if len(self.recent[0]) > max(1 << 16, len(self.main[0]) // 4):
            self.main, self.recent = _merged(self.main, self.recent), _NONE

    def _find(self, hashed: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and count of each piece's ids; the count is -1 where it is not known, -2 where its hash is another piece's."""
        starts, counts = np.zeros(len(hashed), np.int64), np.full(len(hashed), -1)
        mine = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        for table in (self.main, self.recent):
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], hashed), len(table[0]) - 1)
                hit = np.flatnonzero(table[0][at] == hashed)
                at = at[hit]
                equal = _equal(eight, start[hit], size[hit], mine, table[1][at], table[2][at])
                starts[hit], counts[hit] = table[3][at], np.where(equal, table[4][at], -2)
        return starts, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a buffer; empty texts have none."""
        rows = len(offsets) - 1
        plain = _plain(data, offsets) if self.in_pieces else np.diff(offsets) == 0
        if self.added:
            for k in np.flatnonzero(plain & (np.diff(offsets) > 0)).tolist():
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                if any(a in text for a in self.added):
                    plain[k] = False
        mark = np.zeros(len(data) + 1, bool)
        mark[offsets] = True
        feed = np.flatnonzero(data == 0x0A)
        mark[np.flatnonzero(data == 0x20)] = True
        mark[feed] = True
        mark[feed + 1] = True
        cuts = np.flatnonzero(mark)
        start, end = cuts[:-1], cuts[1:]
        owner = np.searchsorted(offsets, start, "right") - 1
        use = plain[owner]
        start, end, owner = start[use], end[use], owner[use]
        if len(self.main[0]) + len(self.recent[0]) > REMEMBERED:
            self.forget()
        size, eight = end - start, eights(data)
        at, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        quick = np.flatnonzero(size <= SHORT)
        hashed, first, inverse = np.unique(hash_spans(data, start[quick], end[quick], eight), return_index=True, return_inverse=True)
        first = quick[first]
        starts, counts = self._find(hashed, eight, start[first], size[first])
        unknown = np.flatnonzero(counts == -1)
        if len(unknown):
            self._learn(data, hashed[unknown], start[first[unknown]], end[first[unknown]])
            starts[unknown], counts[unknown] = self._find(hashed[unknown], eight, start[first[unknown]], size[first[unknown]])
        at[quick], count[quick] = starts[inverse], counts[inverse]
        sound = (counts[inverse] >= 0) & _equal(eight, start[quick], size[quick], eight, start[first][inverse], size[first][inverse])
        others, mark = np.r_[np.flatnonzero(size > SHORT), quick[~sound]], self.used
        if len(others):
            named: dict[bytes, int] = {}
            which = np.array([named.setdefault(data[a:b].tobytes(), len(named)) for a, b in zip(start[others].tolist(), end[others].tolist(), strict=True)])
            first = others[np.unique(which, return_index=True)[1]]
            starts, counts = self._split(data, start[first], end[first])
            at[others], count[others] = starts[which], counts[which]
        total = np.cumsum(count)
        flat = self.ids[np.repeat(at - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)]
        self.used = mark
        bounds = np.r_[0, np.cumsum(np.bincount(owner, count, rows).astype(np.int64))]
        out = [flat[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        whole = np.flatnonzero(~plain).tolist()
        for k, ids in zip(whole, self._whole([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in whole]), strict=True):
            out[k] = ids
        return out


#: A table of pieces without any.
_NONE = (np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 4)


def _merged(a: tuple, b: tuple) -> tuple:
    both = [np.concatenate([x, y]) for x, y in zip(a, b, strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


def _equal(left: np.ndarray, start: np.ndarray, size: np.ndarray, right: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether two spans of up to ``SHORT`` bytes each, of two buffers' ``eights``, are the same bytes."""
    out = size == other_size
    live = np.flatnonzero(out)
    for at in range(0, SHORT, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        out[live] &= lane(left, start[live], size[live], at) == lane(right, other[live], size[live], at)
    return out


def _cuts_at_spaces(tokenizer) -> bool:
    """Whether the tokenizer is a byte-level BPE that splits by the byte-level rule and changes no text before."""
    try:
        rule = json.loads(tokenizer.pre_tokenizer.__getstate__())
    except (AttributeError, TypeError, ValueError):
        return False
    bpe = type(tokenizer.model).__name__ == "BPE" and not tokenizer.model.dropout
    return bpe and tokenizer.normalizer is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") is True and rule.get("add_prefix_space") is False


def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts whose only white space is single spaces and line feeds between other characters."""
    n = len(data)
    odd = np.zeros(n + 1, bool)
    white = (data == 0x20) | (data == 0x0A)
    odd[:n] = (data >= 0x09) & (data <= 0x0D) & (data != 0x0A)
    odd[1:n] |= white[1:] & white[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    odd[edges] |= white[edges]
    edges = offsets[1:][np.diff(offsets) > 0] - 1
    odd[edges] |= white[edges]
    # The UTF-8 forms of other white space.
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        if len(at):
            b, c = data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
            if lead == 0xC2:
                odd[at] |= (b == 0x85) | (b == 0xA0)
            elif lead == 0xE1:
                odd[at] |= (b == 0x9A) & (c == 0x80)
            elif lead == 0xE2:
                odd[at] |= (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
            else:
                odd[at] |= (b == 0x80) & (c == 0x80)
    sums = np.r_[0, np.cumsum(odd[:n])]
    return sums[offsets[1:]] == sums[offsets[:-1]]


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker: loading the vocabulary takes as long as encoding megabytes."""
    return Encoder(path)


# --- the format -----------------------------------------------------------------------------------------------------


def encode_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def decode_key(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


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
    from hashlib import blake2b

    a, b = struct.unpack("<QQ", blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % (1 << 64) % bits for i in range(7)]


class Writer:
    """Writes one table; keys must come in ascending order."""

    def __init__(self, out, width: int) -> None:
        import zstandard

        self.out, self.width, self.at = out, width, len(MAGIC)
        self.squeeze = zstandard.ZstdCompressor(level=1).compress
        self.block, self.index, self.keys = bytearray(), [], []
        self.first, self.last, self.entries, self.docs, self.tokens = b"", b"", 0, 0, 0
        out.write(MAGIC)

    def add(self, key: bytes, value: bytes) -> None:
        if not self.entries:
            self.first, shared = key, 0
        else:
            if key < self.last:
                raise ValueError("keys must ascend")
            shared = len(os.path.commonprefix([key, self.last]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries, self.docs, self.tokens = key, self.entries + 1, self.docs + 1, self.tokens + len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.entries:
            data = self.squeeze(bytes(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), self.entries))
            self.at += len(data)
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self.flush()
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) + _varint(c) for k, o, n, c in self.index)
        self.out.write(packed)
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(packed), self.at + len(packed), len(index), self.docs, self.tokens, self.width, zlib.crc32(packed + index), MAGIC))


class Table:
    """Reads one table: a scan in key order, or a lookup by Bloom filter, index and one block."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, os.SEEK_END)
        file.seek(file.tell() - FOOTER.size)
        bloom_at, bloom_n, index_at, index_n, self.docs, self.tokens, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        file.seek(bloom_at)
        bloom, index = file.read(bloom_n), file.read(index_n)
        if zlib.crc32(bloom + index) != crc:
            raise ValueError("damaged token table")
        self.bits = struct.unpack("<Q", bloom[:8])[0]
        self.bloom, self.blocks, at = bloom[8:], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            offset, at = _read_varint(index, at)
            size, at = _read_varint(index, at)
            count, at = _read_varint(index, at)
            self.blocks.append((key, offset, size, count))

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        _, offset, size, count = self.blocks[block]
        self.file.seek(offset)
        data, at, key = zstandard.decompress(self.file.read(size)), 0, b""
        for _ in range(count):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + other], at + other
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at)
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.blocks)):
            for key, ids in self.entries(block):
                yield decode_key(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All ids under the identifier: none, one, or more where it was repeated."""
        key = encode_key(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        firsts = [b[0] for b in self.blocks]
        out, block = [], max(0, bisect.bisect_left(firsts, key) - 1)
        while block < len(self.blocks) and firsts[block] <= key:
            out += [ids for k, ids in self.entries(block) if k == key]
            block += 1
        return out


# --- on Spark -------------------------------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(documents: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes the shards and returns (shard, path, docs, tokens), one row for each non-empty shard.

    ``documents``: doc_id (any integer, may be null or repeated) and text (null: no ids but the end id). Other columns
    are not read. An empty table writes nothing.
    """
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, out = TaskContext.get().partitionId(), None, None
        store, root = _open(folder)
        final = f"{root}/shard-{shard:07d}.sst"
        temporary = f"{root}/_{shard:07d}-{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None and batch.num_rows:
                coder = encoder(tokenizer)
                end = np.array([END], coder.dtype)
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temporary)
                writer = Writer(out, coder.dtype.itemsize)
            ids = batch.column("doc_id").to_pylist()
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, PIECE_BYTES):
                part = offsets[lo : hi + 1]
                for doc_id, value in zip(ids[lo:hi], coder.encode(data[part[0] : part[-1]], part - part[0]), strict=True):
                    writer.add(encode_key(doc_id), value.tobytes() + end.tobytes())
        if writer is not None:
            writer.close()
            out.close()
            settle()
            if store.type_name != "local" and store.get_file_info(final).is_file:
                store.delete_file(final)
            store.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:07d}.sst"], "docs": [writer.docs], "tokens": [writer.tokens]})

    # equal rows are split by where they come from, so that no one task gets all of them
    keyed = docs.withColumn("tie", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    dealt = keyed.repartitionByRange(shards, "doc_id", "tie", "part").sortWithinPartitions("doc_id", "tie", "text")
    return cut(dealt.select("doc_id", "text").mapInArrow(run, "shard long, path string, docs long, tokens long"), "token-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the shard's path of every document, read back from the shards."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, path string"
    count = manifest.count()
    if not count:
        return spark.createDataFrame([], schema)
    # running sums within groups of shards, and before each group the sums of those before it, one row a group
    rows = manifest.withColumn("group", F.floor(F.col("shard") / 4096))
    within = F.sum("tokens").over(Window.partitionBy("group").orderBy("shard")) - F.col("tokens")
    groups = rows.groupBy("group").agg(F.sum("tokens").alias("all"))
    groups = groups.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("base"))
    starts = rows.withColumn("within", within).join(groups, "group").select("path", (F.col("base") + F.col("within")).alias("start"))
    tasks = max(min(count, 4 * spark.sparkContext.defaultParallelism), -(-count // READ_SHARDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, place = _open(path)
                out: list[list] = [[], [], [], [], []]
                with store.open_input_file(place) as file:
                    for doc_id, ids in Table(file).scan():
                        for column, x in zip(out, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path), strict=True):
                            column.append(x)
                        at += len(ids)
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "path"])

    return starts.repartition(tasks).mapInArrow(run, schema)


def token_shards(documents: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes ``documents`` as token shards and returns what reading them back says of each document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = documents.sparkSession
    manifest = write_shards(documents, tokenizer, folder or new_folder(spark, "token-shards"))
    return read_shards(spark, manifest)
