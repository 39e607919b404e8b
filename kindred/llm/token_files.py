"""Token ids in directly addressable files (operator 1).

A file holds the ids of consecutive documents as directly addressable codes: level 0 keeps the
low 8 bits of every id, level 1 the next 8 bits of those ids that need them, and so on. Each level
has a continuation bitmap (does the id go on at the next level?) and a rank directory (ones before
each block of 512 bits), so any token is found by one rank query a level, without decoding a block.

Layout, little-endian: magic, counts, then 8-byte aligned sections in the order written by
:func:`pack`. A folder of such files plus a ``manifest`` table is one token set in ascending
document order.

Defined cases: a null text is the empty text (only the end id); null ids sort first; rows that
repeat a doc_id are all written, ordered by text hash; an empty table gives an empty token set;
extra columns are ignored; an added token's string in a text is that token, as the library has it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.chunks import library_ids
from kindred.llm.common import bounded_batches, documents, scratch, text_of

MAGIC = b"DACTOK02"
LEVEL_BITS = 8
BLOCK = 512
#: Ids that a writer gathers before it closes a file; a longer document gets a file of its own.
FILE_TOKENS = 4_000_000


def _aligned(x: bytes) -> bytes:
    return x + b"\0" * (-len(x) % 8)


def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_starts: np.ndarray, n_null: int = 0) -> bytes:
    """The bytes of one file. ``doc_starts`` has one entry more than ``doc_ids``, of which the first ``n_null`` are null."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= (1 << LEVEL_BITS)
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> LEVEL_BITS
        if not len(rest):
            break
    head = MAGIC + struct.pack("<QQQQ", len(ids), len(doc_ids), n_null, len(levels))
    head += b"".join(struct.pack("<QQQ", *map(len, x)) for x in levels)
    body = b"".join(_aligned(part) for x in levels for part in x)
    return head + _aligned(doc_ids.astype("<i8").tobytes()) + _aligned(doc_starts.astype("<u8").tobytes()) + body


class TokenFile:
    """Reads one file; ``data`` may be bytes, an Arrow buffer or a memory map."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n_tokens, self.n_docs, self.n_null, n_levels = struct.unpack_from("<QQQQ", view, 8)
        sizes = [struct.unpack_from("<QQQ", view, 40 + 24 * i) for i in range(n_levels)]
        at = 40 + 24 * n_levels

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(view[at : at + n], kind)
            at += n + (-n % 8)
            return got

        self.doc_ids = take(8 * self.n_docs, "<i8")
        self.doc_starts = take(8 * (self.n_docs + 1), "<u8")
        self.levels = [(take(a, "u1"), take(b, "u1"), take(c, "<u8")) for a, b, c in sizes]

    def _rank(self, level: int, i: int) -> int:
        """Ones of a level's bitmap before position i."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        part = bits[block * (BLOCK // 8) : i // 8]
        tail = int(bits[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ranks[block]) + int(np.bitwise_count(part).sum()) + tail.bit_count()

    def token(self, i: int) -> int:
        """The id at position i, by a rank query a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (codes, bits, _) in enumerate(self.levels):
            value |= int(codes[i]) << (LEVEL_BITS * level)
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(level, i)
        raise ValueError("a code goes on beyond the last level")

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """The ids at positions lo to hi as unsigned 32-bit integers."""
        out = np.zeros(hi - lo, "<u4")
        where = np.arange(hi - lo)
        for level, (codes, bits, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= codes[lo:hi].astype(np.uint32) << np.uint32(LEVEL_BITS * level)
            more = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            where = where[more]
            if level + 1 < len(self.levels):
                lo = self._rank(level, lo)
                hi = lo + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.doc_starts[k]), int(self.doc_starts[k + 1]))


def _put(path: str, data: bytes) -> None:
    """Write under another name, then move: a lost or repeated task leaves no half file."""
    import os
    import uuid

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, at)


def open_token_file(path: str) -> TokenFile:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return TokenFile(f.read_buffer())


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every document, append ``end_id`` and write the ids in ascending document order.

    One range exchange orders the documents; each task then encodes and writes its own range.
    Returns the manifest: a row for each file with its path, counts and ``start``, the ids in all
    files before it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files = TaskContext.get().partitionId(), 0
        ids, keys, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal files, held
            lengths = np.array([len(x) + 1 for x in ids], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            at = f"{path}/{part:06d}-{files:06d}.dac"
            whole = np.full(starts[-1], end_id, "<u4")
            for x, start in zip(ids, starts.tolist()):
                whole[start : start + len(x)] = x
            n_null = keys.count(None)  # these come first
            _put(at, pack(whole, np.array([0 if k is None else k for k in keys], np.int64), starts, n_null))
            row = {"part": [part], "file": [files], "path": [at], "n_docs": [len(keys)], "n_tokens": [int(starts[-1])]}
            files += 1
            held = 0
            ids.clear()
            keys.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            found = library_ids(tokenizer, batch.column(1).to_pylist(), added=True)
            for key, got in zip(batch.column(0).to_pylist(), found):
                ids.append(got)
                keys.append(key)
                held += len(got) + 1
                if held >= file_tokens:
                    yield close()
        if keys:
            yield close()

    keyed = docs.select(F.col(doc_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    ordered = keyed.repartitionByRange(F.col("doc").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(write, "part long, file long, path string, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with running sums: within each part, and over one row for each part."""
    files = spark.read.schema("part long, file long, path string, n_docs long, n_tokens long").parquet(f"{path}/manifest")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("_base"))
    inner = files.withColumn("start", before(Window.partitionBy("part").orderBy("file")))
    return inner.join(parts, "part").withColumn("start", F.col("start") + F.col("_base")).drop("_base")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document what the files hold: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = open_token_file(path)
                ids = memoryview(got.tokens(0, got.n_tokens)).cast("B")
                bounds = got.doc_starts.astype(np.int64)
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                keys = pa.array(got.doc_ids.copy(), mask=np.arange(got.n_docs) < got.n_null)
                yield pa.RecordBatch.from_arrays([keys, pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    return read_token_files(write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json")))
