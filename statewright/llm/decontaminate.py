"""Benchmark decontamination by pigeonhole edit matching.

A test item of n normalised characters may be found with k = floor(rate * n)
edits.  It is split into k + 1 pieces; k edits leave one piece whole, so exact
hits of the pieces (one automaton over a block of items) propose places.  The
pieces are the leaves of a binary tree over the item: where a branch of c pieces
has c - 1 edits at most, one of its halves keeps the same bound.  So some hit has
every branch above it within its bound, and a hit is given up at the first branch
that isn't: most go after two pieces.  Myers' bit-parallel distance verifies the
branches and last the item.  Places that propose the same window of the same item
are verified once.

Items are the stated query set and are held in blocks of a bounded number of
characters; each block meets every document in one pass over the whole texts.
A pass is local to a row: no shuffle, memory bounded by a block's automaton and
one Arrow batch.

Defined results
    Texts are compared in lower case with white space runs as one space.  Null
    or empty items match nothing; null texts count as empty.  Items of under
    ``SHORT_CHARS`` normalised characters are found as they stand, without edits,
    where no letter or digit joins them: inside a text too.  The best place of each item in a document is reported
    (least distance, then first).  Repeated rows are searched alike.  Items
    repeated under other ids are each reported.  Empty documents or an empty
    benchmark give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remember_only, settle_in_small_batches, spread_name

RATE = 0.1
#: Items of fewer characters are one piece, found between the edges of words; 0: all items are found with edits.
SHORT_CHARS = 32
#: Characters of items in one block: bounds the automaton in a worker.
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """Start and text of the k + 1 pieces, as even as can be."""
    n = len(item)
    parts = min(n, int(rate * n) + 1)
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def best_end(bits: dict[str, int], m: int, text: str, enough: int = 0) -> tuple[int, int]:
    """Least edit distance of a pattern of length m to any substring of ``text``, and that substring's end (the first such); any within ``enough`` will do."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full  # the text's start is free
        down = (down << 1) & full
        plus = down | (full & ~(d0 | up))
        minus = up & d0
        if score < best:
            best, end = score, at
            if best <= enough:
                break
    return best, end


def stands(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit outside joins one at the ends of a part."""
    joined = lambda a, b: text[a].isalnum() and text[b].isalnum()
    return not (start > 0 and joined(start - 1, start)) and not (end < len(text) and joined(end - 1, end))


class Item:
    """A test item with its pieces, and the branches above them in a binary tree."""

    __slots__ = ("name", "text", "short", "cuts", "budget", "bits", "back", "above")

    def __init__(self, name: object, text: str, rate: float, short_chars: int = 0) -> None:
        self.name, self.text, self.short = name, text, len(text) < short_chars
        found = pieces(text, 0.0 if self.short else rate)
        self.cuts = [start for start, _ in found] + [len(text)]
        self.budget = len(found) - 1
        self.bits: dict[tuple[int, int], dict[str, int]] = {}
        self.back: dict[str, int] | None = None
        self.above: dict[int, list[tuple[int, int, int, int, int, tuple[str, ...]]]] = {}

    def branches(self, piece: int) -> Iterator[tuple[int, int]]:
        """First and last piece (exclusive) of the branches above a piece, from the smallest, without the whole."""
        low, high, above = 0, self.budget + 1, []
        while high - low > 2:
            half = (low + high) // 2
            low, high = (low, half) if piece < half else (half, high)
            if high - low > 1:
                above.append((low, high))
        return reversed(above)

    def pattern(self, low: int, high: int) -> dict[str, int]:
        found = self.bits.get((low, high))
        if found is None:
            found = self.bits[low, high] = pattern_bits(self.text[self.cuts[low] : self.cuts[high]])
        return found

    def rest(self, piece: int, low: int, high: int) -> tuple[str, ...]:
        """Parts of a branch beside one of its pieces, one more than it may have edits: one of them is whole."""
        sides = [(self.cuts[low], self.cuts[piece]), (self.cuts[piece + 1], self.cuts[high])]
        total, parts, out = sum(b - a for a, b in sides), high - low, []
        for a, b in sides:
            share = max(1, -(-parts * (b - a) // total)) if b > a else 0
            out += [self.text[a + (b - a) * i // share : a + (b - a) * (i + 1) // share] for i in range(share)]
        return tuple(out)

    def checks(self, piece: int) -> list[tuple[int, int, int, int, int, tuple[str, ...]]]:
        """For each branch above a piece: its pieces, its size, where the piece is in it, its edits, and parts of which one is whole."""
        found = self.above.get(piece)
        if found is None:
            found = self.above[piece] = []
            for low, high in self.branches(piece):
                a, b = self.cuts[low], self.cuts[high]
                found.append((low, high, b - a, self.cuts[piece] - a, high - low - 1, self.rest(piece, low, high)))
        return found

    def bears(self, piece: int, at: int, text: str, known: dict) -> bool:
        """Whether a hit of a piece at ``at`` has every branch above it within its bound."""
        for low, high, size, offset, edits, rest in self.checks(piece):
            start = at - offset
            part = text[max(0, start - edits) : start + size + edits]
            for piece_of_rest in rest:
                if piece_of_rest in part:
                    break
            else:
                return False
            key = (id(self), low, high, part)  # texts repeat themselves
            found = known.get(key)
            if found is None:
                found = known[key] = best_end(self.pattern(low, high), size, part, edits)[0] <= edits
            if not found:
                return False
        return True


class Block:
    """Items and their pieces in one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float, short_chars: int = SHORT_CHARS) -> None:
        import ahocorasick

        self.items = [Item(name, text, rate, short_chars) for name, text in items]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.owners: list[list[tuple[int, int]]] = []
        self.sizes: list[int] = []
        seen: dict[str, int] = {}
        for k, item in enumerate(self.items):
            for i, (a, b) in enumerate(zip(item.cuts, item.cuts[1:], strict=False)):
                piece = item.text[a:b]
                at = seen.get(piece)
                if at is None:
                    at = seen[piece] = len(self.owners)
                    self.owners.append([])
                    self.sizes.append(len(piece))
                    self.machine.add_word(piece, at)
                self.owners[at].append((k, i))
        self.machine.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """Item number, distance, start and end in the normalised text, of each item found."""
        proposed: dict[int, set[int]] = {}
        standing: dict[int, int] = {}  # short items and the first place where they stand
        known: dict[tuple, bool] = {}
        for last, piece in self.machine.iter(text) if self.owners else ():
            at = last + 1 - self.sizes[piece]
            for k, i in self.owners[piece]:
                item = self.items[k]
                if item.short:
                    if k not in standing and stands(text, at, last + 1):
                        standing[k] = at
                    continue
                shift = at - item.cuts[i]
                found = proposed.get(k)
                if (found is None or shift not in found) and item.bears(i, at, text, known):
                    proposed.setdefault(k, set()).add(shift)
            if len(known) > 100_000:
                known.clear()
        for k, at in standing.items():
            yield k, 0, at, at + len(self.items[k].text)
        for k, shifts in proposed.items():
            item = self.items[k]
            m, budget = len(item.text), item.budget
            best: tuple[int, int, int] | None = None
            for a, b in self.windows(sorted(shifts), m, budget, len(text)):
                part = text[a:b]
                if (at := part.find(item.text)) >= 0:
                    best = (0, a + at, a + at + m)
                    break
                distance, end = best_end(item.pattern(0, budget + 1), m, part)
                if distance <= budget and (best is None or distance < best[0]):
                    # The reversed pattern, in the reversed text before that end, gives the start.
                    if item.back is None:
                        item.back = pattern_bits(item.text[::-1])
                    _, back = best_end(item.back, m, part[max(0, end - m - budget) : end][::-1])
                    best = (distance, a + end - back, a + end)
            if best is not None:
                yield k, *best

    @staticmethod
    def windows(shifts: list[int], m: int, budget: int, size: int) -> Iterator[tuple[int, int]]:
        """Windows around proposed starts; overlapping proposals share one."""
        at = 0
        while at < len(shifts):
            last = at
            while last + 1 < len(shifts) and shifts[last + 1] - shifts[at] <= m:
                last += 1
            yield max(0, shifts[at] - budget), min(size, shifts[last] + m + budget)
            at = last + 1


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, str]]]:
    """Normalised items in blocks of ``limit`` characters, read one after another."""
    block: list[tuple[object, str]] = []
    size = 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        text = normal(row[1])
        if not text:
            continue
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, short_chars: int = SHORT_CHARS
) -> DataFrame:
    """doc_id, item_id, distance, item_chars, start, end, text_key: the best place of each item found in each row."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    shape = f"doc_id {kind}, item_id {item_kind}, distance int, item_chars int, start bigint, end bigint, text_key bigint"
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col))

    def searched(items: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            remember_only("decontaminate")
            block = Block(items, rate, short_chars)
            for batch in batches:
                at, found = [], []
                for row, value in enumerate(batch.column(1)):
                    for k, distance, start, end in block.search(normal(value.as_py())):
                        at.append(row)
                        found.append((items[k][0], distance, len(items[k][1]), start, end))
                where = pa.array(at, pa.int64())
                kinds = (item_type, pa.int32(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)]
                names = ["doc_id", "item_id", "distance", "item_chars", "start", "end", "text_key"]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), *columns, batch.column(2).take(where)], names)

        return rows.mapInArrow(run, shape)

    out: DataFrame | None = None
    for items in item_blocks(benchmark, item_id, item_text, block_chars):
        part = searched(items)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], shape)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` without the rows that hold a test item, all columns as they were."""
    found = contamination(docs, benchmark, id_col, text_col, rate=rate)
    hit = settle_in_small_batches(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    key = spread_name(docs.columns, "_text_key")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    return keyed.join(hit, (keyed[key] == hit["_key"]) & keyed[id_col].eqNullSafe(hit["_id"]), "left_anti").select(*docs.columns)
