"""Token files as wavelet matrices (operator 2: token-ID output).

Documents are ordered by id in range partitions; each task encodes its texts and cuts the id stream into shards. A shard is one
compressed file image: for every bit of an id, from the highest down, the bit plane of the ids stably split by the bits before,
with a directory of counts. Access, counting and the places of a token are answered from the planes without decoding the stream.
The images are rows of a Parquet table, so any store that Spark can write holds them.

Cases: a null or empty text has only the end id; an empty table gives no shards and no rows; rows with the same id are ordered by
their text, nulls first, and each counts; a null id sorts first; other columns are ignored; a text longer than a shard has a shard
of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buffers import slices
from .encoding import encoder, tokenizer_path

#: Ids in a shard before it is closed.
SHARD_TOKENS = 2_000_000
END_ID = 1
#: Bytes of text encoded at once; more text shares more of its distinct pieces.
SLICE_BYTES = 2 << 20
MAGIC = b"WVM1"
BLOCK = 2048
FILES = "part int, seq int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, image binary"


def build(ids: np.ndarray) -> bytes:
    """The file image of a sequence of unsigned ids."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    heads, bodies = [], []
    for level in range(levels - 1, -1, -1):
        bit = ((now >> now.dtype.type(level)) & now.dtype.type(1)).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        zeros, ones = np.flatnonzero(~bit), np.flatnonzero(bit)
        directory = np.searchsorted(ones, np.arange(0, len(now) + BLOCK, BLOCK)).astype(np.uint32)
        body = pa.compress(directory.tobytes() + plane.tobytes(), codec="zstd", asbytes=True)
        heads.append(struct.pack("<QI", len(zeros), len(body)))
        bodies.append(body)
        now = np.concatenate([now.take(zeros), now.take(ones)])
    return MAGIC + struct.pack("<QI", len(ids), levels) + b"".join(heads) + b"".join(bodies)


class WaveletMatrix:
    """Queries on a file image."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token file")
        self.size, levels = struct.unpack_from("<QI", image, 4)
        heads = [struct.unpack_from("<QI", image, 16 + 12 * i) for i in range(levels)]
        at, blocks = 16 + 12 * levels, 1 + -(-self.size // BLOCK)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        for zeros, length in heads:
            raw = pa.decompress(image[at : at + length], 4 * blocks + -(-self.size // 8), codec="zstd", asbytes=True)
            self.levels.append((zeros, np.frombuffer(raw, np.uint32, blocks), np.frombuffer(raw, np.uint8, offset=4 * blocks)))
            at += length

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits of a plane are set: the directory's count plus those of the block so far."""
        _, directory, plane = self.levels[level]
        block = at // BLOCK
        span = np.arange(BLOCK // 8)
        take = block[:, None] * (BLOCK // 8) + span
        bits = np.where(take < len(plane), plane[np.minimum(take, len(plane) - 1)], 0).astype(np.uint8) if len(plane) else np.zeros(take.shape, np.uint8)
        left = np.clip(at[:, None] - take * 8, 0, 8)
        return directory[block].astype(np.int64) + np.bitwise_count(bits & ((1 << left) - 1).astype(np.uint8)).sum(1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The ids at these places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for level, (zeros, _, plane) in enumerate(self.levels):
            bit = (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self._ones(level, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences among the places low to high stand below the last plane."""
        if token >> len(self.levels):
            return 0, 0
        for level, (zeros, _, _) in enumerate(self.levels):
            ones = self._ones(level, np.array([low, high], np.int64))
            low, high = (zeros + ones if token >> (len(self.levels) - 1 - level) & 1 else np.array([low, high]) - ones).tolist()
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token stands at the places from low up to high (not included)."""
        a, b = self._range(token, low, self.size if high is None else high)
        return b - a

    def find(self, token: int) -> np.ndarray:
        """All places of a token, in order: its run below the last plane, carried up plane by plane with select."""
        low, high = self._range(token, 0, self.size)
        at = np.arange(low, high)
        for level in range(len(self.levels) - 1, -1, -1):
            zeros, _, plane = self.levels[level]
            bit = np.unpackbits(plane, count=self.size, bitorder="little").astype(bool)
            at = np.flatnonzero(bit)[at - zeros] if token >> (len(self.levels) - 1 - level) & 1 else np.flatnonzero(~bit)[at]
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence: the stable splits undone from the lowest plane up."""
        now = np.zeros(self.size, np.uint16 if len(self.levels) <= 16 else np.uint32)
        for power, (zeros, _, plane) in enumerate(reversed(self.levels)):
            bit = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            back = np.empty_like(now)
            back[np.flatnonzero(~bit)] = now[:zeros]
            back[np.flatnonzero(bit)] = now[zeros:]
            back |= bit.astype(now.dtype) << now.dtype.type(power)
            now = back
        return now.astype(np.uint32)


def _encode(path: str, end_id: int, shard_tokens: int, id_index: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seq = encoder(path)(), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list = []
        sizes: list[int] = []
        for batch, data, offsets in slices(batches, limit=SLICE_BYTES):
            ids, starts = pieces.encode(data, offsets)
            with_end = np.insert(ids, starts[1:], end_id)
            starts = starts + np.arange(len(starts))
            doc_ids = batch.column(id_index).to_pylist()
            row = 0
            while row < len(doc_ids):
                # rows that fit into the open shard; one that is too long alone goes in alone
                room = shard_tokens - sum(map(len, held)) + int(starts[row])
                to = int(np.searchsorted(starts, room, "right")) - 1
                if to <= row and held:
                    yield _shard(part, seq, docs, sizes, held)
                    seq, held, docs, sizes = seq + 1, [], [], []
                    continue
                to = max(to, row + 1)
                held.append(with_end[starts[row] : starts[to]])
                docs += doc_ids[row:to]
                sizes += np.diff(starts[row : to + 1]).tolist()
                row = to
        if held:
            yield _shard(part, seq, docs, sizes, held)

    return run


def _shard(part: int, seq: int, docs: list, sizes: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(held)
    columns = {"part": ([part], pa.int32()), "seq": ([seq], pa.int32()), "doc_ids": ([docs], pa.list_(pa.int64())), "doc_tokens": ([sizes], pa.list_(pa.int64())), "n_tokens": ([len(ids)], pa.int64()), "image": ([build(ids)], pa.binary())}
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the documents' token files in ascending id order below a folder; returns the table of shards."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(path, end_id, shard_tokens, 0), FILES).write.parquet(folder)
    return open_files(docs.sparkSession, folder)


def open_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(folder)


def shard_starts(files: DataFrame) -> DataFrame:
    """Ids before each shard. Shards of a partition are summed there; across partitions one row each is summed."""
    within = files.select("part", "seq", "n_tokens").withColumn("before", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    return within.join(parts, "part").select("part", "seq", (F.col("before") + F.col("parts_before")).alias("shard_start"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, docs, sizes, image in zip(*(batch.column(c) for c in ("part", "seq", "doc_ids", "doc_tokens", "image")), strict=True):
            raw = WaveletMatrix(image.as_buffer().to_pybytes()).decode().astype("<u4")
            n = sizes.values.to_numpy()
            ends = np.cumsum(n)
            view = memoryview(raw.tobytes())
            crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [docs.values, pa.array([part.as_py()] * rows, pa.int32()), pa.array([seq.as_py()] * rows, pa.int32()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "seq", "within", "n_tokens", "ids_crc32"],
            )


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: where its ids start in the whole stream, how many they are, their checksum."""
    rows = files.mapInArrow(_decode, "doc_id bigint, part int, seq int, within bigint, n_tokens bigint, ids_crc32 bigint")
    at: Column = F.col("shard_start") + F.col("within")
    return rows.join(shard_starts(files), ["part", "seq"]).select("doc_id", at.alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def count_token(files: DataFrame, token: int) -> DataFrame:
    """How often a token occurs in each shard, from rank on the planes alone."""

    def run(batches):
        for batch in batches:
            counts = [WaveletMatrix(x.as_py()).count(token) for x in batch.column("image")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), pa.array(counts, pa.int64())], names=["part", "seq", "n"])

    return files.select("part", "seq", "image").mapInArrow(run, "part int, seq int, n bigint")


def find_token(files: DataFrame, token: int) -> DataFrame:
    """Every place of a token in the whole stream, from rank and select."""

    def run(batches):
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c) for c in ("part", "seq", "image")), strict=True):
                at = WaveletMatrix(image.as_py()).find(token)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(at), pa.int32()), pa.array([seq.as_py()] * len(at), pa.int32()), pa.array(at, pa.int64())], names=["part", "seq", "within"])

    places = files.select("part", "seq", "image").mapInArrow(run, "part int, seq int, within bigint")
    return places.join(shard_starts(files), ["part", "seq"]).select((F.col("shard_start") + F.col("within")).alias("place"))
