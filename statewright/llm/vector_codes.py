"""Product codes of vectors in exact integers, the nearest entry found behind segment-mean lower bounds.

Components become integers floor(scale * x); a vector is cut into equal parts,
and each part position has a codebook.  A codebook starts with that part of the
first vectors by id; each round gives every part to its nearest entry (ties to
the lower index) and moves each entry to the floored mean of its parts.

Nearest entries are found coarse to fine.  With a part and an entry cut into b
blocks, the squared distance is at least what the block means differ by plus the
squared difference of the two residual norms, that is of what the means leave
over.  For b = 1, 2, 4, ... entries whose bound exceeds the distance of the most
promising one are out; what is left gets its exact integer distance.  Bounds are
lowered by more than their rounding error, so no nearest entry is ever lost.

How it is laid out on a cluster
    * The integers are written once; each round reads them where they lie and
      every task sends one sum for each codebook cell, added up before they come
      to the driver: as many numbers as the codebooks have, whatever the table.
    * Labels are added up before the shuffle; the sums are broadcast only if they
      are few (checked), else joined by a shuffle that adaptive execution splits.

Defined results
    Rows whose vector is null, empty, or holds a null or non-finite component are
    dropped.  A null id comes after all others; rows with one id go by their
    integers; repeated rows count each.  With fewer rows than entries each row is
    an entry.  Vectors of different lengths, lengths that the parts don't divide
    and components too large for exact 64-bit distances raise.  An empty table
    gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.small import HELD_ROWS
from .common import discard, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A component times the width of a part stays below this, so that sums of squares times the width fit into 64 bits.
MOST = 1 << 30


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, ints of the rows that are kept."""
    v = F.col(vector_col)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd))
    large = F.exists(v, lambda x: F.abs(x.cast("double")) * scale * (F.size(v) / parts) >= MOST)
    checked = F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")))
    return kept.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), checked.alias("ints"))


class Means:
    """Sums and residual norms of rows (n x w integers) at every level of blocks."""

    def __init__(self, rows: np.ndarray) -> None:
        n, w = rows.shape
        squares = (rows * rows).sum(axis=1)
        self.levels = []
        blocks = 1
        while blocks < w and w % blocks == 0:
            sums, width = rows.reshape(n, blocks, w // blocks).sum(axis=2), w // blocks
            residual = np.sqrt((squares * width - (sums * sums).sum(axis=1)) / width)  # whole numbers until the root
            self.levels.append((sums, residual, width))
            blocks *= 2


def lower_bound(sums: np.ndarray, others: np.ndarray, residual: np.ndarray, other: np.ndarray, width: int) -> np.ndarray:
    """A number that no squared distance is below, rounding included."""
    gap = sums - others
    return ((gap * gap).sum(axis=-1) / width + (residual - other) ** 2) * (1 - 1e-8) - 1


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower of equals, and its squared distance."""
    n, k = len(rows), len(entries)
    ours, theirs = Means(rows).levels, Means(entries).levels
    exact = lambda r, e: ((rows[r] - entries[e]) ** 2).sum(axis=1)
    if ours:
        (sums, residual, width), (their_sums, their_residual, _) = ours[0], theirs[0]
        bound = lower_bound(sums[:, None], their_sums[None], residual[:, None], their_residual[None], width)
        least = exact(np.arange(n), bound.argmin(axis=1))  # of the most promising entry of each row
        at, entry = np.nonzero(bound <= least[:, None])
    else:
        at, entry = np.divmod(np.arange(n * k), k)
    for (sums, residual, width), (their_sums, their_residual, _) in zip(ours[1:], theirs[1:], strict=True):
        alive = lower_bound(sums[at], their_sums[entry], residual[at], their_residual[entry], width) <= least[at]
        at, entry = at[alive], entry[alive]
    distance = np.full((n, k), np.iinfo(np.int64).max)
    distance[at, entry] = exact(at, entry)
    chosen = distance.argmin(axis=1)
    return chosen, distance[np.arange(n), chosen]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    values, rows = column.flatten(), len(column)
    if len(values) != rows * dims or (rows and np.any(np.diff(column.offsets.to_numpy()) != dims)):
        raise ValueError("vectors differ in length")
    return values.to_numpy(zero_copy_only=False).reshape(rows, dims).astype(np.int64)


def trained(ints: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x width) after the rounds; no entries for an empty table."""
    first = [r["ints"] for r in ints.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()]  # as many as entries
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    dims = len(first[0])
    if any(len(v) != dims for v in first):
        raise ValueError("vectors differ in length")
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    width, k = dims // parts, len(first)
    books = np.array(first, dtype=np.int64).reshape(k, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        now = books.copy()

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, k, width + 1), dtype=np.int64)  # sums by component, then the count
            for batch in batches:
                rows = matrix(batch.column(0), dims)
                for p in range(parts):
                    own = rows[:, p * width : (p + 1) * width]
                    chosen, _ = nearest(own, now[p])
                    np.add.at(total[p, :, :width], chosen, own)
                    total[p, :, width] += np.bincount(chosen, minlength=k)
            flat = total.ravel()
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["cell", "total"])

        summed = ints.select("ints").mapInArrow(cells, "cell bigint, total bigint").groupBy("cell").agg(F.sum("total").alias("total")).collect()  # a row per number of the codebooks at most
        total = np.zeros(parts * k * (width + 1), dtype=np.int64)
        for r in summed:
            total[r["cell"]] = r["total"]
        total = total.reshape(parts, k, width + 1)
        sums, counts = total[:, :, :width], total[:, :, width:]
        books = np.where(counts > 0, sums // np.maximum(counts, 1), books)
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    ints = settle(integers(vectors, id_col, vector_col, label_col, scale, parts))
    books = trained(ints, parts, entries, rounds)
    text = ",".join(map(str, books.ravel().tolist()))
    width = books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(2), parts * width)
            found = [nearest(rows[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            names = digits[np.stack([c for c, _ in found], axis=1)]
            codes = ["".join(row) for row in names.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    kinds = [ints.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    coded = settle(ints.select("vec_id", "label", "ints").mapInArrow(code, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint"))
    discard(ints)
    totals = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    few = len(totals.select("_label").limit(HELD_ROWS + 1).collect()) <= HELD_ROWS
    both = coded.join(F.broadcast(totals) if few else totals, coded["label"].eqNullSafe(totals["_label"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


__all__ = ["nearest", "trained", "vector_codes"]
