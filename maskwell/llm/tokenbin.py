"""Token ids as fixed-width bit-packed files.

Documents are range-partitioned and sorted by doc_id; each task encodes its own and writes one
immutable file into the shared folder, under a temporary name that is renamed when it is
complete, so a task that runs again replaces its file as a whole. The number of files follows from
the bytes of text. (Texts are shuffled, not ids: packed ids do not compress and take as much room, and
would have to be written once more to be shuffled by range.)

File (little endian): magic ``MWTB``, u32 version, u32 bits an id, u32 ids a block, u64 ids, u64
documents, u64 blocks; u64 byte offsets of the blocks (and of the end); u64 first id of each
document (and of the end); the blocks. A block holds ``block`` ids of ``bits`` bits each, low
bits first, and begins at a byte, so any id is found without reading others.

Null and empty texts are the end id alone. Repeated rows are documents of their own. Null doc_ids
come first; rows of one doc_id are ordered by the length of their text, then a hash of it, so that only
rows alike can change places, and a doc_id of many rows spreads over several files. Very long texts
fill many blocks. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import run_path, small_batches, write_table

END_ID, BLOCK, FILE_BYTES = 0, 1024, 128 << 20
_HEAD = struct.Struct("<4sIIIQQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, low bits first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | np.ndarray, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits == 16:
        return raw[: 2 * n].view("<u2").astype(np.uint32)
    flat = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI: local, HDFS and object stores alike."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return (fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


class Writer:
    """One file; blocks go out as they fill, so memory is bounded by the offsets."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.fs, self.path = filesystem(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.body = self.fs.open_output_stream(self.temporary + ".body")
        self.bits, self.block, self.n = bits, block, 0
        self.blocks, self.docs, self.rest, self.at = [0], [0], np.empty(0, np.uint32), 0

    def add(self, documents: list[np.ndarray]) -> None:
        self.docs.extend((self.n + np.cumsum([len(x) for x in documents])).tolist())
        self.n = self.docs[-1]
        ids = np.concatenate([self.rest, *documents])
        whole = len(ids) // self.block
        self._put(ids[: whole * self.block], whole)
        self.rest = ids[whole * self.block :]

    def _put(self, ids: np.ndarray, blocks: int) -> None:
        size = (self.block * self.bits + 7) // 8
        if self.block * self.bits % 8 == 0:
            self.body.write(pack_bits(ids, self.bits))
        else:
            for k in range(blocks):
                self.body.write(pack_bits(ids[k * self.block : (k + 1) * self.block], self.bits))
        self.blocks.extend(range(self.at + size, self.at + size * blocks + 1, size))
        self.at += size * blocks

    def close(self) -> None:
        if len(self.rest):
            data = pack_bits(self.rest, self.bits)
            self.body.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
        self.body.close()
        head = _HEAD.size + 8 * (len(self.blocks) + len(self.docs))
        with self.fs.open_output_stream(self.temporary) as out:
            out.write(_HEAD.pack(b"MWTB", 1, self.bits, self.block, self.n, len(self.docs) - 1, len(self.blocks) - 1))
            out.write((np.array(self.blocks, "<u8") + head).tobytes())
            out.write(np.array(self.docs, "<u8").tobytes())
            with self.fs.open_input_stream(self.temporary + ".body") as body:
                while data := body.read(1 << 22):
                    out.write(data)
        self.fs.delete_file(self.temporary + ".body")
        self.fs.move(self.temporary, self.path)


class Reader:
    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.file = self.fs.open_input_file(self.path)
        _, _, self.bits, self.block, self.n, docs, blocks = _HEAD.unpack(self.file.read(_HEAD.size))
        self.blocks = np.frombuffer(self.file.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self.file.read(8 * (docs + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1: reads the blocks that hold them only."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        self.file.seek(int(self.blocks[a]))
        raw = np.frombuffer(self.file.read(int(self.blocks[b + 1] - self.blocks[a])), np.uint8)
        n, size = min((b + 1) * self.block, self.n) - a * self.block, int(self.blocks[a + 1] - self.blocks[a])
        if self.block * self.bits % 8 == 0:
            out = unpack_bits(raw, n, self.bits)
        else:
            out = np.concatenate([unpack_bits(raw[k * size : (k + 1) * size], min(self.block, n - k * self.block), self.bits) for k in range(b - a + 1)])
        return out[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.docs[k]), int(self.docs[k + 1]))

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, path: str, end_id: int = END_ID, block: int = BLOCK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the files. Returns a written table: doc_id, shard, nth (in its file),
    uri, in the files' order."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = run_path(spark, "tokens")
    bits = bits_for(tokens.load(path).vocabulary)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # files of about the wanted size; of a small table a few for each core
    shards = max(1, -(-size // file_bytes), min(4 * spark.sparkContext.defaultParallelism, -(-32 * size // file_bytes)))
    order = ["doc_id", "n", "tie", "row"]
    keyed = rows.withColumns({"n": F.octet_length("text"), "tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("shard", T.IntegerType()), ("nth", T.LongType()), ("uri", T.StringType())]

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words, shard = tokens.load(path), TaskContext.get().partitionId()
        uri, out, n = f"{folder}/{shard:06d}.tok", None, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = out or Writer(uri, bits, block)
                out.add([np.frombuffer(x + end, "<u4") for x in words.encode(part.column("text").to_pylist())])
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([shard] * m, pa.int32()), pa.array(np.arange(n, n + m)), pa.array([uri] * m)], names=[f[0] for f in fields])
                n += m
        if out:
            out.close()

    return write_table(ordered.mapInArrow(encode, T.StructType([T.StructField(*f) for f in fields])), "tokens-index")[0]


def read_back(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids of every document, from the files. Collected: a row for each file."""
    spark = index.sparkSession
    files = index.groupBy("shard", "uri").agg(F.count("*").alias("docs")).orderBy("shard").collect()
    if not files:
        zero = F.lit(0).cast("long")
        return index.select("doc_id", zero.alias("start"), zero.alias("n_tokens"), zero.alias("ids_crc32"), *[F.lit(b"").alias("ids")] * with_ids)
    listed = spark.createDataFrame([(r["shard"], r["uri"]) for r in files], "shard int, uri string").repartition(len(files))

    def totals(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, uri in zip(batch.column("shard").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                r = Reader(uri)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([r.n], pa.int64())], names=["shard", "n"])
                r.close()

    base, before = [], 0
    sizes = {r["shard"]: r["n"] for r in listed.mapInArrow(totals, "shard int, n long").collect()}
    for r in files:
        base.append((r["shard"], r["uri"], before))
        before += sizes[r["shard"]]
    starts = spark.createDataFrame(base, "shard int, uri string, base long").repartition(len(files), "shard")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, uri, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "uri", "base")), strict=True):
                r = Reader(uri)
                for at in range(0, len(r.docs) - 1, 512):
                    stop = min(at + 512, len(r.docs) - 1)
                    edges = r.docs[at : stop + 1]
                    ids = r.ids(int(edges[0]), int(edges[-1]))
                    rows = [ids[a - edges[0] : b - edges[0]].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    out = [pa.array([shard] * len(rows), pa.int32()), pa.array(np.arange(at, stop)), pa.array(first + edges[:-1]), pa.array(np.diff(edges)), pa.array([zlib.crc32(x) for x in rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out + [pa.array(rows, pa.binary())] * with_ids, names=names)
                r.close()

    schema = "shard int, nth long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    back = starts.mapInArrow(read, schema)
    return back.join(index.select("doc_id", "shard", "nth").hint("merge"), ["shard", "nth"]).select("doc_id", *names[2:])
