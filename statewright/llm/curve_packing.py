"""Packing along a space-filling curve: documents that resemble each other share sequences.

The token ids of a document are a hashed vector: each id adds its sign in one of
``BUCKETS`` places.  A fixed matrix of signs projects it to ``DIMS`` coordinates,
divided by the document's length.  Coordinates are set on a grid around their
mean over all documents, and the grid cell's number along a Hilbert curve is the
document's key: neighbours on the curve are neighbours in space.  Documents in
order of their keys are one long run of ids, cut into sequences of the capacity.
Only the last one isn't full; it is cut into sequences whose lengths are powers
of two, which need no padding.

How it is laid out on a cluster
    * Texts are read once, tokenised and written as ids of two bytes.
    * Keys are sorted by range with the row's number as a second key, so that
      equal documents are dealt out, however many.  A range sums its lengths
      while it is read in order; the sums of the ranges (a row each) say where
      each begins.
    * Ids move once, joined by the row's number with the place on the curve.

Defined results
    Null text counts as empty: a document of the end id only.  Null ids are kept.
    Repeated rows and ties of the key are packed as separate documents, in order
    of their number.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch_tokens import batch_ids, runs
from .common import discard, partitions, remember_only, settle, settle_in_small_batches
from .packing import word_ids

CAPACITY = 4096
BUCKETS = 1 << 12
DIMS, BITS = 4, 10
#: Coordinates are whole numbers of this part of one.
UNIT = 1 << 20
#: Standard deviations from the mean to an edge of the grid; what lies beyond is set on the edge.
REACH = 3
#: Bytes of text that are tokenised together.
TOGETHER = 1 << 22
#: Words remembered per generation of a worker's cache.
REMEMBERED = 600_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit digest of whole numbers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def directions(n_ids: int, dims: int = DIMS, buckets: int = BUCKETS) -> np.ndarray:
    """What each token id adds to each coordinate: its sign in its bucket times the bucket's row of the matrix of signs."""
    digest = mixed(np.arange(n_ids))
    sign = 1 - 2 * (digest & np.uint64(1)).astype(np.int8)
    bucket = (digest >> np.uint64(1)) % np.uint64(buckets)
    matrix = mixed(np.arange(buckets * dims) + (1 << 40)).reshape(buckets, dims)
    return sign[:, None] * (1 - 2 * (matrix & np.uint64(1)).astype(np.int8))[bucket.astype(np.int64)]


def coordinates(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The projected vectors of documents (n x dims whole numbers) from ids one after another; none is empty."""
    sums = np.add.reduceat(table[ids], bounds[:-1], axis=0, dtype=np.int64) if len(bounds) > 1 else np.zeros((0, table.shape[1]), np.int64)
    return sums * UNIT // np.diff(bounds)[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers along the Hilbert curve of grid cells (n x dims, each below 2^bits)."""
    x = [c.astype(np.int64) for c in cells.T]
    # From the highest bit down, each level of the curve is turned back to its first orientation.
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for i in range(len(x)):
            upper = (x[i] >> bit) & 1
            swap = np.where(upper == 1, 0, (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ swap ^ (upper * below)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flips ^= ((x[-1] >> bit) & 1) * ((1 << bit) - 1)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flips) >> bit) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, dims: int) -> DataFrame:
    """item, doc_id, doc_tokens, ids (little-endian, two bytes each if they all fit), x_0 to x_<dims - 1>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("packing")
        known = word_ids(tokenizer, REMEMBERED)
        count = max(known.size, end_id + 1)
        table, kind = directions(count, dims), "<u2" if count <= 1 << 16 else "<u4"
        for batch in batches:
            for part in runs(batch, 1, TOGETHER):
                ids, bounds = batch_ids(known, part.column(1), end_id)
                x = coordinates(ids, bounds, table)
                raw = ids.astype(kind)
                held = [raw[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [part.column(0), pa.array(np.diff(bounds)), pa.array(held, pa.binary()), *(pa.array(x[:, i].copy()) for i in range(dims))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "ids", *(f"x_{i}" for i in range(dims))])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, doc_tokens bigint, ids binary, " + ", ".join(f"x_{i} bigint" for i in range(dims))
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(work, shape).withColumn("item", F.monotonically_increasing_id())


def curve_keys(points: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """item, doc_tokens, key: the grid is laid around the mean of all documents."""
    names = [f"x_{i}" for i in range(dims)]
    told = points.agg(*[F.round(F.avg(c)).alias(f"m_{c}") for c in names], *[F.round(F.stddev_pop(c)).alias(f"s_{c}") for c in names]).first()
    mean = np.array([told[f"m_{c}"] or 0 for c in names])
    step = np.maximum(1.0, np.array([told[f"s_{c}"] or 0 for c in names]) * 2 * REACH / (1 << bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(dims)], axis=1)
            cells = np.clip(np.floor((x - mean) / step) + (1 << (bits - 1)), 0, (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(cells, bits))], ["item", "doc_tokens", "key"])

    return points.select("item", "doc_tokens", *names).mapInArrow(work, "item bigint, doc_tokens bigint, key bigint")


def places_on_curve(keys: DataFrame) -> tuple[DataFrame, int]:
    """item, place: ids before each document in order of (key, item); and the number of all ids."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            upto = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(upto - n), pa.array(upto)], ["item", "range", "start", "upto"])
            before = int(upto[-1]) if len(n) else before

    spread = keys.repartitionByRange(partitions(keys.sparkSession), "key", "item").sortWithinPartitions("key", "item")
    placed = settle(spread.select("item", "doc_tokens").mapInArrow(running, "item bigint, range int, start bigint, upto bigint"))
    sizes = {r["range"]: r["size"] for r in placed.groupBy("range").agg(F.max("upto").alias("size")).collect()}  # one row per range
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    offsets = keys.sparkSession.createDataFrame(list(before.items()), "range int, base bigint")
    return placed.join(F.broadcast(offsets), "range").select("item", (F.col("start") + F.col("base")).alias("place")), total  # as many rows as ranges are broadcast


def tail_bounds(total: int, capacity: int) -> list[int]:
    """Where the sequences begin after the last full one, and the end: lengths are powers of two, longest first."""
    at = total - total % capacity
    out = [at]
    for bit in range(capacity.bit_length(), -1, -1):
        if (total - at) >> bit:
            at += 1 << bit
            out.append(at)
    return out


def pieces_of(place: int, length: int, capacity: int, tail: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """start, length, sequence, offset of the pieces of a document that lies at ``place`` of the run."""
    at, end = place, place + length
    while at < end:
        if at < tail[0]:
            sequence, first = divmod(at, capacity)
            first, stop = at - first, at - first + capacity
        else:
            k = next(i for i in range(len(tail) - 1) if at < tail[i + 1])
            sequence, first, stop = tail[0] // capacity + k, tail[k], tail[k + 1]
        upto = min(end, stop)
        yield at - place, upto - at, sequence, at - first
        at = upto


def pack_along_curve(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if not 1 <= dims * bits <= 63:
        raise ValueError("a key has 1 to 63 bits: dims times bits")
    ids = settle_in_small_batches(tokenised(docs, tokenizer, id_col, text_col, end_id, dims))
    keys = settle(curve_keys(ids, dims, bits))
    places, total = places_on_curve(keys)
    tail = tail_bounds(total, capacity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(i).to_pylist() for i in range(1, 4))
            for row, (n, raw, place) in enumerate(zip(*columns, strict=True)):
                own = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4")
                out += [(row, start, length, zlib.crc32(own[start : start + length]), n, sequence, offset) for start, length, sequence, offset in pieces_of(place, n, capacity, tail)]
            table = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(table[0], pa.int64())), *(pa.array(c, pa.int64()) for c in table[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    joined = ids.select("item", "doc_id", "doc_tokens", "ids").join(places, "item").select("doc_id", "doc_tokens", "ids", "place")
    kind = ids.schema["doc_id"].dataType.simpleString()
    packed = settle_in_small_batches(joined.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"))
    discard(ids)
    discard(keys)
    return packed


__all__ = ["hilbert", "pack_along_curve", "tail_bounds"]
