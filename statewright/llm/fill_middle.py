"""Fill-in-the-middle: texts cut in three and put together anew, middle last.

Each text is cut into units (code points, or words with the white space after
them).  Two cuts chosen by a digest of the id part it into prefix, middle and
suffix.  The output is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (form psm),
``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm), or the text itself (plain).

The cuts of all rows of an Arrow batch are found together on its UTF-8 buffer: a
table gives each byte a class, a second table says for two adjacent bytes whether
a unit begins at the latter, running sums that start anew with each document
number the units, and one binary search finds the bytes where the cuts lie.

How it is laid out on a cluster
    One pass over the texts, no shuffle; a batch is worked on in runs of bounded
    bytes.  Restoring is an expression of built-in functions.

Defined results
    Null text counts as empty; an empty text is plain with no units.  A null id
    is digested as the empty string.  Repeated rows give repeated results, ties
    don't occur.  A text that holds a marker stays plain, so that every output
    can be restored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are cut together.
TOGETHER = 1 << 22
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_BYTES = np.arange(256)
_WHITE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: By unit: the class of each byte, and for the classes of two adjacent bytes whether a unit begins at the latter.
UNITS: dict[str, tuple[np.ndarray, np.ndarray]] = {
    "points": ((_BYTES & 0xC0 != 0x80).astype(np.uint8), np.array([[False, True], [False, True]])),
    "words": (_WHITE.astype(np.uint8), np.array([[False, False], [True, False]])),
}


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, null as empty, and where each row begins and the last one ends."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64) - offsets[0]


def numbered(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units begun up to each byte of the batch, units before each row, units of each row."""
    classes, begins_at = UNITS[unit]
    kinds = classes[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = begins_at[kinds[:-1], kinds[1:]]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True  # a document's first byte begins a unit whatever came before
    upto = np.cumsum(begins, dtype=np.int32)
    ends = np.concatenate([[0], upto])[offsets]
    return upto, ends[:-1], np.diff(ends)


def holds_marker(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row holds one of the markers."""
    found = np.zeros(len(offsets) - 1, dtype=bool)
    if len(data) < 3:
        return found
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], [ord(c) for c in "PSM"]))
    row = np.searchsorted(offsets, at, side="right") - 1
    found[row[at + 3 <= offsets[row + 1]]] = True
    return found


def rearrange(data: np.ndarray, offsets: np.ndarray, draws: list[np.ndarray], unit: str, rate: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Units, form (0 plain, 1 psm, 2 spm), code points of prefix and of middle, and the output of every row."""
    upto, before, n = numbered(data, offsets, unit)
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    # The byte that begins a unit is the first one up to which so many have begun; after the last unit that is the row's end.
    first, second = (np.searchsorted(upto, before + k + 1, side="left") for k in (np.minimum(one, two), np.maximum(one, two)))
    plain = (n == 0) | holds_marker(data, offsets) | (draws[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[3] % 100 < spm, 2, 1))
    points = np.concatenate([[0], upto if unit == "points" else numbered(data, offsets, "points")[0]])
    raw, out = memoryview(data), []
    for kind, a, p, m, b in zip(form.tolist(), offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), strict=True):
        if kind == 0:
            out.append(bytes(raw[a:b]))
        elif kind == 1:
            out.append(b"".join((PREFIX, raw[a:p], SUFFIX, raw[m:b], MIDDLE, raw[p:m])))
        else:
            out.append(b"".join((SUFFIX, raw[m:b], PREFIX, raw[a:p], MIDDLE, raw[p:m])))
    return n, form, points[first] - points[offsets[:-1]], points[second] - points[first], out


def runs(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in a binary column have about ``size`` bytes, a row at least."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


FORMS = np.array(["plain", "psm", "spm"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "points") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output of every row.

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of those with the suffix
    first.  The draws are the first four groups of 8 hex digits of the sha256 of
    ``seed``, a colon and the id.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}: {', '.join(UNITS)}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, 1, TOGETHER):
                data, offsets = buffers(part.column(1))
                draws = [part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
                n, form, prefix, middle, out = rearrange(data, offsets, draws, unit, rate, spm)
                plain = form == 0
                columns = [part.column(0), pa.array(n.astype(np.int64)), pa.array(FORMS[form]), pa.array(prefix.astype(np.int64), mask=plain), pa.array(middle.astype(np.int64), mask=plain), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    found = docs.select(F.col(id_col), F.col(text_col).cast("binary"), *draws).mapInArrow(work, shape)
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  Its parts hold no marker, and none can arise where a part meets one."""
    before = lambda text, mark: F.substring_index(text, mark.decode(), 1)
    after = lambda text, mark: F.substring_index(text, mark.decode(), -1)
    head, middle = before(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle_digests(docs: DataFrame, **options: object) -> DataFrame:
    """Digests in place of the outputs, and of the texts restored from them."""
    found = fill_in_middle(docs, **options)
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


__all__ = ["fill_in_middle", "fill_in_middle_digests", "restored"]
