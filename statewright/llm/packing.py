"""Hierarchical residual best-fit packing of tokenised documents.

Documents become token ids followed by an end id.  Those over the capacity are
cut into pieces of the capacity (the last may be shorter), nothing else is cut.
Items are packed best-fit, longest first, inside groups of a bounded number of
items; nearly full bins are emitted.  The underfull bins are the items of the
next round, in as many groups as their number asks for, and so on up a tree
until one group has packed what was left.

How it is laid out on a cluster
    * Texts are read once and never shuffled; a piece travels as six numbers.
    * A group holds ``group_items`` items on average, dealt by a hash of the
      item's own number, so neither a hot document nor growth makes it larger.
    * Every round's decision is written to the shared folder before the next.

Defined results
    Null text counts as empty: a document of the end id only.  Null ids are kept.
    Repeated rows are packed as separate documents.  Items of equal length are
    placed in order of their number.  An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remember_only, remembers, settle, settle_in_small_batches

CAPACITY = 2048
GROUP_ITEMS = 16_384
#: A bin with at most this part of its capacity left is nearly full.
NEARLY = 1 / 128
#: Words remembered per generation of a worker's cache; two generations live at a time.
REMEMBERED = 400_000
#: Bytes of text whose words are looked up together.
TOGETHER = 1 << 22


#: What may follow a run of letters and is a run of its own: not the apostrophe, which begins endings.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'"))
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters by which the byte-level tokenizer writes bytes: printable ones stand for themselves, the rest come after 255 in order.
WRITTEN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


class WordIds(dict):
    """Ids of white-space-free words as little-endian 32-bit bytes, remembered in two generations.

    The tokenizer never joins characters across white space and folds case, so
    the ids of a text are those of its words one after another.  A word of letters
    is one run of the tokenizer, marks after it are another.  Letters up to U+012F
    are composed already: such a run is lowered and given to the tokenizer's model
    directly.  All other words go through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.old, self.remembered = Tokenizer.from_file(path), {}, remembered
        self.model, self.marks, self.size = self.tokenizer.model, {}, max(self.tokenizer.get_vocab().values()) + 1

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def letters(self, run: bytes) -> bytes | None:
        """Ids of a run of letters; None if it isn't one."""
        text = run.decode("utf-8", "replace")
        if not text.isalpha() or max(text) >= "\u0130":
            return None
        if (ids := self.get(run)) is not None:
            return ids
        text = text.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(WRITTEN)
        ids = [token.id for token in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[bytes]) -> None:
        for word in words:
            if (ids := self.old.get(word)) is None:
                run = word.rstrip(MARKS)
                ids = self.letters(run)
                if ids is None:
                    ids = self.encode(word.decode("utf-8", "replace"))
                elif len(run) < len(word):
                    self[run], mark = ids, word[len(run) :]
                    if mark not in self.marks:
                        self.marks[mark] = self.encode(mark.decode())
                    ids += self.marks[mark]
            self[word] = ids

    def of(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > self.remembered:
            self.old = dict(self)
            self.clear()
        lists: list[list[bytes] | None] = []
        for data in texts:
            if b"<|" in data:  # may spell a special token: leave it to the tokenizer
                lists.append(None)
                continue
            if b"\xcc" not in data and b"\xcd" not in data:  # no combining marks: folding A-Z early changes nothing
                data = data.lower()
            lists.append(data.split())
        found = [x if x is None else list(map(self.get, x)) for x in lists]
        lacking = [i for i, f in enumerate(found) if f is not None and None in f]
        self.learn({w for i in lacking for w, f in zip(lists[i], found[i], strict=True) if f is None})
        for i in lacking:
            found[i] = [self[w] if f is None else f for w, f in zip(lists[i], found[i], strict=True)]
        return [self.encode(t.decode("utf-8", "replace")) if f is None else b"".join(f) for t, f in zip(texts, found, strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    return WordIds(path, remembered)


remembers("packing", word_ids.cache_clear)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .batch_tokens import batch_ids, runs  # that module reads this one

        remember_only("packing")
        known = word_ids(tokenizer)
        for batch in batches:
            for texts in runs(batch, 1, TOGETHER):
                ids, bounds = batch_ids(known, texts.column(1), end_id)
                at, piece, start, length, crc = [], [], [], [], []
                for row, (first, last) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    for k, a in enumerate(range(first, last, capacity)):
                        part = ids[a : min(a + capacity, last)]
                        at.append(row)
                        piece.append(k)
                        start.append(a - first)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                columns = [texts.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(cut, shape)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, fill of each bin: longest first, each into the fullest bin that takes it."""
    bins, offsets, fill = [0] * len(sizes), [0] * len(sizes), []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r left
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            chosen, room = len(fill), capacity
            fill.append(0)
        bins[item], offsets[item] = chosen, fill[chosen]
        fill[chosen] += size
        if left := room - size:
            with_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets, fill


def _packed_round(items: DataFrame, level: int, groups: int, capacity: int) -> DataFrame:
    """item, bin, offset, fill: the items of each group packed best-fit."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item")
        bins, offsets, fill = best_fit(part["size"].tolist(), capacity)
        first = (level << 56) | (int(part["part"].iloc[0]) << 24)
        fills = np.array(fill, dtype=np.int64)[bins]
        return pd.DataFrame({"item": part["item"].to_numpy(), "bin": first + np.array(bins, dtype=np.int64), "offset": np.array(offsets, dtype=np.int64), "fill": fills})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(pack, "item bigint, bin bigint, offset bigint, fill bigint")


def pack_items(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """item, sequence_id, offset for ``items`` (item: a distinct long, size: 1 to capacity)."""
    full = items.where(F.col("size") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rounds: list[DataFrame] = []
    left = items.where(F.col("size") < capacity)
    count = left.count()
    level = 1
    while count:
        groups = -(-count // group_items)
        placed = settle(_packed_round(left, level, groups, capacity))
        rounds.append(placed)
        if groups == 1:
            break
        left = placed.where(F.col("fill") < capacity - int(capacity * NEARLY)).select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        before, count = count, left.count()
        if len(rounds) > 1 and count == before:
            break  # no two of what is left fit together in any group
        level += 1
    above: DataFrame | None = None
    for placed in reversed(rounds):
        own = placed.select("item", F.col("bin").alias("sequence_id"), "offset")
        if above is not None:
            up = above.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("_up"), F.col("offset").alias("_shift"))
            own = own.join(up, "sequence_id", "left").select(
                "item", F.coalesce("_up", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset")
            )
        above = own
    return full if above is None else full.unionByName(above)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    pieces = settle_in_small_batches(pieces.withColumn("item", F.monotonically_increasing_id()))
    places = pack_items(pieces.select("item", F.col("length").alias("size")), capacity, group_items)
    return pieces.join(places, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


__all__ = ["best_fit", "pack_documents", "pack_items", "token_pieces", "word_ids"]
