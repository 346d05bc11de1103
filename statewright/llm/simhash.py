"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint has 64 bits, each the majority of that bit over the hashes of all
shingles.  Fingerprints within two bits are linked.  They are cut into three
segments.  If two fingerprints differ in two bits at most, some segment is
equal while the next (cyclically) differs in one bit at most.  The perfect
binary Golay code makes that second condition a key: a segment is decoded to
its nearest codeword, and so is every word one bit away.  Those decode to one
codeword, or to six where the segment lies at the code's covering radius, and
two segments one bit apart always share one of these.  A key joins the equal
segment with a codeword index: some 34 bits, 16 keys a fingerprint on average.

Fingerprints that share a key are compared and kept if they are within two
bits.  A key shared by many distinct fingerprints (one large group of near
copies) isn't compared pair by pair: its fingerprints are linked through the
words one bit away.  Two words within two bits share such a midpoint, and a
midpoint has 65 words around it at most, so the work is linear and no link of
the graph's connectivity is lost.

Two bits are little: a few changed words in a page of text move more of them.
Given a ``similarity``, texts with at least that Jaccard similarity of five-word
shingles are linked too (see :mod:`.shingles`).

How it is laid out on a cluster
    Texts are read once and never shuffled.  Equal fingerprints are one node.
    Keys are counted with map-side combine; single keys, nearly all, are
    dropped before anything is gathered.  Links and components stay in tables.

Defined results
    Null text counts as empty; a text without words has fingerprint zero and is
    linked like any other.  Repeated rows share a component.  Null ids take part
    but never name a component that has another id.  Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, remember_only, remembers, settle, settle_in_small_batches, spread_name
from .components import components
from .shingles import similar_links, sketch

SHINGLE, SEED, RADIUS = 3, 42, 2
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width: 22 + 21 + 21 bits
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xC75
#: Keys shared by more distinct fingerprints than this are linked through midpoints.
PAIRWISE = 64


def fingerprint(data: bytes) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    import xxhash

    words = data.lower().split()  # of bytes: folds A-Z only, splits at space and tab to carriage return only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), 1 << 16):
        ones += np.unpackbits(digests[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long), text_key (digest of the text itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"") for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_key"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary"), F.xxhash64(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint, text_key bigint")


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprints`` with the digest and the keys of each text's set of five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("simhash")
        longs = pa.list_(pa.int64())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x.as_py() or b"" for x in batch.column(1)]
                fps = np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts))
                names, bands = zip(*map(sketch, texts), strict=True)
                more = [pa.array(names, pa.int64()), pa.array([x.view(np.int64) for x in bands], longs)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2), *more], ["doc_id", "fp", "text_key", "set_key", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary"), F.xxhash64(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint, text_key bigint, set_key bigint, bands array<bigint>")


@lru_cache(maxsize=1)
def decoded_index() -> np.ndarray:
    """For each of the 2^23 words the 12-bit index of the one codeword within three bits."""
    def remainder(x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ np.uint32(GENERATOR << (bit - 11)), x)
        return x

    singles = [1 << i for i in range(23)]
    leaders = [0, *singles]
    leaders += [a | b for i, a in enumerate(singles) for b in singles[i + 1 :]]
    leaders += [a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[i + 1 :], i + 1) for c in singles[j + 1 :]]
    errors = np.array(leaders, dtype=np.uint32)
    by_syndrome = np.zeros(1 << 11, dtype=np.uint32)
    by_syndrome[remainder(errors)] = errors
    out = np.empty(1 << 23, dtype=np.uint16)
    for at in range(0, len(out), 1 << 18):  # in parts, so that a worker's memory stays small
        words = np.arange(at, at + (1 << 18), dtype=np.uint32)
        out[at : at + (1 << 18)] = (words ^ by_syndrome[remainder(words)]) >> 11
    return out


remembers("simhash", decoded_index.cache_clear)


def segment(fps: np.ndarray, i: int) -> np.ndarray:
    shift, width = SEGMENTS[i]
    return (fps >> np.uint64(shift)).astype(np.uint64) & np.uint64((1 << width) - 1)


def key_sets(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: every key of every fingerprint, once each."""
    index, rows, keys = decoded_index(), [], []
    for i in range(3):
        j = (i + 1) % 3
        near = segment(fps, j)
        around = np.concatenate([[0], 1 << np.arange(SEGMENTS[j][1])]).astype(np.uint64)
        codes = np.sort(index[near[:, None] ^ around[None, :]].astype(np.int64), axis=1)
        new = np.ones(codes.shape, dtype=bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, col = np.nonzero(new)
        rows.append(row)
        keys.append((i << 34) | (segment(fps, i).astype(np.int64)[row] << 12) | codes[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(nodes: DataFrame) -> DataFrame:
    """key, fp for the distinct fingerprints ``nodes`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, keys = key_sets(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part.view(np.int64)[rows])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key bigint, fp bigint")


def _close(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b}) <= {RADIUS}"


def links(nodes: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Verified links (a, b) that join all distinct fingerprints within two bits into components."""
    keyed = settle(golay_keys(nodes))
    counts = settle(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = settle(keyed.join(counts, "key"))
    discard(keyed)
    few = shared.where(F.col("n") <= pairwise).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = few.selectExpr(
        f"explode(flatten(transform(fps, (x, i) -> transform(filter(slice(fps, i + 2, size(fps)), y -> {_close('x', 'y')}), y -> named_struct('a', x, 'b', y))))) AS pair"
    ).select("pair.a", "pair.b")
    # Hot keys: through words one bit away, which have 65 words around them at most.
    many = shared.where(F.col("n") > pairwise).select("fp").distinct()
    middle = many.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) AS middle")
    stars = middle.groupBy("middle").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    stars = stars.selectExpr("array_min(fps) AS a", "explode(fps) AS b").where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairwise: int = PAIRWISE, similarity: float | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, fp, text_key, component_id, root (fingerprint that names the component)."""
    whole = settle(fingerprints(docs, id_col, text_col)) if similarity is None else settle_in_small_batches(sketched(docs, id_col, text_col))
    rows = whole.select("doc_id", "fp", "text_key")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(nodes, pairwise)
    if similarity is not None:
        edges = edges.unionByName(similar_links(whole, docs, similarity, text_col))
    roots = settle(components(edges))
    placed = settle(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = settle(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    known = settle(placed.select("fp", "root").join(named, "root").select(F.col("fp").alias("_fp"), "root", "component_id"))
    return rows.join(known, rows["fp"] == known["_fp"]).drop("_fp")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_groups(docs, id_col, text_col)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, all columns as they were."""
    found = settle(near_groups(docs, id_col, text_col, similarity=similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("first")
    own = {c: spread_name(docs.columns, c) for c in ("_id", "_key")}
    kept = settle(found.groupBy("root").agg(first).select(F.col("first.id").alias(own["_id"]), F.col("first.key").alias(own["_key"])).distinct())
    keyed = docs.withColumn("_" + own["_key"], F.xxhash64(text_col))
    same = keyed[id_col].eqNullSafe(kept[own["_id"]]) & keyed["_" + own["_key"]].eqNullSafe(kept[own["_key"]])
    left = keyed.join(kept, same, "left_semi")
    again = ["_" + own["_key"], id_col]
    twice = settle(left.groupBy(*again).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    alike = left[id_col].eqNullSafe(twice[id_col]) & left[again[0]].eqNullSafe(twice[again[0]])
    single = left.join(twice, alike, "left_semi").groupBy(*again).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return left.join(twice, alike, "left_anti").select(*docs.columns).unionByName(single)
