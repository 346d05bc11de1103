"""Quality classifier: an interpolated modified Kneser-Ney model over characters.

All text that the labels call good trains two models, one on each half of the
trusted documents (halves by a digest of the id), and every document is scored
by the model of the other half: its own text is never among the counts it is
held against, whether it is trusted or not.  The counts, the lower orders'
continuation counts and the context totals are tables, sharded by n-gram or
context, and joined order by order to interpolated probabilities.  A document's
score is its mean negative log probability a character; it is rejected if it
lies above a quantile of the trusted documents of its language, by more than
chance allows at its length (the score less ``SIGMAS`` standard errors is
compared, so that short texts are judged leniently).

How it is laid out on a cluster
    * Counting covers every trusted document.  A task merges its n-grams before
      the shuffle, so what travels is the distinct n-grams of each split.
    * All that is looked up for one position of a text ends in the same two
      symbols (before the last, for a probability; last, for a context).  The
      model is cut into shards by these two, as many as keep a shard within
      ``SHARD_BYTES`` (counted first).  Each shard is one broadcast and one pass
      over the texts that scores the positions in its charge; a document's partial
      sums are added.  N-grams of documents are never shuffled, and no more than a
      shard is ever held on the driver or in a worker, however large the model is.
    * Quantiles come from counts in bins of 0.001 nats: as many rows as bins.

Symbols
    Code points take one symbol of 12 bits below ``WIDE``, and two above (a high
    part, then a low part), so that no two texts are written alike.

Defined results
    Null text counts as empty; an empty text has its end alone and is scored as
    such.  A language without ``LEAST_TRUSTED`` trusted documents (null counts
    as a language) is held against all trusted documents.  Without any trusted
    document nothing is rejected.  A doc_id with several labels is trusted if
    any of them is good; labels and documents of null id never match.  Repeated
    rows get the same verdict.  Texts are scored whole, however long.  An empty
    table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, remember_only, remembers, settle, settle_in_small_batches, spread_name

ORDER = 5
BITS = 12
#: Code points from here on are written as two symbols: this plus their upper bits, then their lower 12 bits.
WIDE = 3824
START, END = 1, 2
QUANTILE = 0.995
SIGMAS = 2.0
LEAST_TRUSTED = 30
LEAST_DISCOUNT = 0.1
#: Bytes of model rows in one shard (a gram, a probability and a weight each).
SHARD_BYTES = 64 << 20
ROW_BYTES = 16
#: Fixed value: odd multiplier that spreads pairs of symbols over shards.
SPREAD = 40503
BROADCAST_LABELS = 2_000_000
SYMBOLS = 1 << BITS
BIN = 0.001
#: Characters handled at a time.
CHUNK = 1 << 19


def symbols(text: str) -> np.ndarray:
    """Symbols of a text: white space as one space, digits alike, case kept."""
    points = np.frombuffer(re.sub(r"\s+", " ", text).strip().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    points[(points >= 48) & (points < 58)] = 48
    wide = points >= WIDE
    if not wide.any():
        return points
    places = np.cumsum(wide + 1) - 1
    out = np.empty(places[-1] + 1, dtype=np.int64)
    out[places] = np.where(wide, points & (SYMBOLS - 1), points)
    out[places[wide] - 1] = WIDE + (points[wide] >> BITS)
    return out


def ngrams(text: str, order: int) -> np.ndarray:
    """Packed n-grams that end at each symbol and at the end."""
    x = np.concatenate([np.full(order - 1, START), symbols(text), [END]])
    n = len(x) - order + 1
    keys = x[:n].copy()
    for i in range(1, order):
        keys <<= BITS
        keys |= x[i : i + n]
    return keys


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts).astype(np.float64), len(found)).astype(np.int64)


def count_ngrams(texts: DataFrame, text_col: str, order: int, half_col: str) -> DataFrame:
    """half, gram, n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def fold() -> None:
            nonlocal held, size
            for half, parts in held.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                total[half] = _merged([total[half][0], keys], [total[half][1], counts]) if half in total else (keys, counts)
            held, size = {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for half, (keys, counts) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), half, dtype=np.int32)), pa.array(keys), pa.array(counts)], ["half", "gram", "n"])
            total.clear()

        for batch in batches:
            for half, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(half, []).append(ngrams(value.as_py() or "", order))
                size += len(held[half][-1])
                if size >= CHUNK:
                    fold()
            if sum(len(k) for k, _ in total.values()) > 4 * CHUNK:
                yield from out()
        fold()
        yield from out()

    return texts.select(half_col, text_col).mapInArrow(run, "half int, gram bigint, n bigint").groupBy("half", "gram").agg(F.sum("n").alias("n"))


def discounts(counts_of: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times.

    Never below ``LEAST_DISCOUNT``: where few n-grams are known an estimate can
    be zero, and nothing would be left for what wasn't seen.
    """
    n1, n2, n3, n4 = (counts_of.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    raw = [1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)]
    return [min(max(d, LEAST_DISCOUNT), top) for d, top in zip(raw, (1.0, 2.0, 3.0), strict=True)]


def train(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """From n-gram counts (half, gram, n) a model for each half: half, ord, gram, logp, backoff.

    For each n-gram seen, its log probability in full interpolation and, as a
    context, the log weight of the next lower order (null if it is none).
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):  # continuation counts: how many distinct symbols stand before
        shorter = levels[k + 1].select("half", F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("gram"))
        levels[k] = settle(shorter.groupBy("half", "gram").agg(F.count("*").alias("n")))
    below: DataFrame | None = None
    out: DataFrame | None = None
    held: list[DataFrame] = []
    for k in range(1, order + 1):
        few: dict[int, dict[int, int]] = {}
        for r in levels[k].where("n <= 4").groupBy("half", "n").agg(F.count("*").alias("m")).collect():
            few.setdefault(r["half"], {})[r["n"]] = r["m"]
        cut = F.lit(None).cast("double")
        for half, found in few.items():
            for seen, d in enumerate(discounts(found), 1):
                cut = F.when((F.col("half") == half) & (F.least("n", F.lit(3)) == seen), d).otherwise(cut)
        cut = F.coalesce(cut, F.lit(0.0))
        here = levels[k].withColumns({"cut": cut, "context": F.shiftrightunsigned("gram", BITS), "shorter": F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))})
        weights = settle(here.groupBy("half", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight")))
        here = here.join(weights, ["half", "context"])
        if below is None:
            here = here.withColumn("low", F.lit(1.0 / SYMBOLS))
        else:
            here = here.join(below.select("half", F.col("gram").alias("shorter"), F.col("p").alias("low")), ["half", "shorter"])
        below = settle(here.select("half", "gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("low")).alias("p")))
        none = F.lit(None).cast("double")
        # Contexts of an order are n-grams of the one below it; the empty context is gram 0 of order 0.
        back = weights.select("half", F.lit(k - 1).alias("ord"), F.col("context").alias("gram"), none.alias("logp"), F.log("weight").alias("backoff"))
        seen = below.select("half", F.lit(k).alias("ord"), "gram", F.log("p").alias("logp"), none.alias("backoff"))
        out = back.unionByName(seen) if out is None else out.unionByName(back).unionByName(seen)
        held += [weights, below]
    model = settle(out.coalesce(partitions(out.sparkSession)))
    for old in (*[levels[k] for k in range(1, order)], *held):
        discard(old)
    return model


class Table:
    """Lookup of packed n-grams: one probe of a hashed slot, a binary search for what isn't there."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_value = np.zeros(1 << bits, dtype=np.float32)
        slots = self.slots(self.keys)
        self.slot_key[slots], self.slot_value[slots] = self.keys, self.values
        self.spilt = bool((self.slot_key[slots] != self.keys).any())

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and which were found."""
        slots = self.slots(keys)
        hit = self.slot_key[slots] == keys
        values = np.where(hit, self.slot_value[slots], np.float32(0))
        if self.spilt and not hit.all():
            rest = np.nonzero(~hit)[0]
            at = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            ok = self.keys[at] == keys[rest]
            hit[rest[ok]] = True
            values[rest[ok]] = self.values[at[ok]]
        return values, hit


class Scorer:
    def __init__(self, columns: dict[str, np.ndarray], order: int) -> None:
        self.order, self.logp, self.backoff = order, {}, {}
        for k in range(order + 1):
            here = columns["ord"] == k
            for name, into in (("logp", self.logp), ("backoff", self.backoff)):
                values = columns[name][here]
                known = ~np.isnan(values)
                if known.any():
                    into[k] = Table(columns["gram"][here][known], values[known].astype(np.float32))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each packed n-gram."""
        out = np.zeros(len(keys), dtype=np.float64)
        todo, gathered = np.arange(len(keys)), np.zeros(len(keys), dtype=np.float64)
        for k in range(self.order, 0, -1):
            if k in self.logp:
                values, hit = self.logp[k].find(keys)
                out[todo[hit]] = gathered[hit] + values[hit]
                keys, todo, gathered = keys[~hit], todo[~hit], gathered[~hit]
            if not len(keys):
                return out
            if k - 1 in self.backoff:
                gathered = gathered + self.backoff[k - 1].find(keys >> BITS)[0]
            keys = keys & ((1 << (BITS * (k - 1))) - 1)
        out[todo] = gathered - np.log(SYMBOLS)
        return out


_SCORERS: dict[str, list[Scorer]] = {}
remembers("kneser_ney", _SCORERS.clear)


def _scorers(name: str, models: Broadcast, order: int) -> list[Scorer]:
    """The worker's scorers of the models so named, built once."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = [Scorer(m, order) for m in models.value]
    return _SCORERS[name]


def _in_shard(pairs: np.ndarray, shards: int, shard: int) -> np.ndarray:
    return ((pairs * SPREAD) >> 8) % shards == shard


def _shard_of(model: DataFrame, shards: int, shard: int) -> DataFrame:
    """The model's rows that positions of a shard look up; the shortest are in all shards."""
    pair = F.when(F.col("logp").isNotNull(), F.shiftrightunsigned("gram", BITS)).otherwise(F.col("gram")).bitwiseAND(F.lit((1 << (2 * BITS)) - 1))
    short = F.when(F.col("logp").isNotNull(), F.col("ord") < 3).otherwise(F.col("ord") < 2)
    return model.where(short | (F.shiftright(pair * SPREAD, 8) % shards == shard))


def _partial_sums(docs: DataFrame, text_col: str, model: DataFrame, order: int, keep: list[str], shards: int, shard: int) -> tuple[DataFrame, Broadcast]:
    """The columns ``keep`` with s1, s2 (sums of log probabilities and of their squares) and symbols over the shard's positions of each row."""
    rows = (model if shards == 1 else _shard_of(model, shards, shard)).select("half", "ord", "gram", F.col("logp").cast("float"), F.col("backoff").cast("float")).toArrow()
    columns = {c: rows.column(c).to_numpy() for c in rows.column_names}
    tables = [{c: columns[c][columns["half"] == half] for c in ("ord", "gram", "logp", "backoff")} for half in (0, 1)]
    del rows, columns
    shared, name = docs.sparkSession.sparkContext.broadcast(tables), uuid.uuid4().hex
    del tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("kneser_ney")
        scorers = _scorers(name, shared, order)
        for batch in batches:
            texts, at = batch.column(batch.num_columns - 1), 0
            half = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            sums: list[list[np.ndarray]] = [[], [], []]
            while at < len(texts):
                held, size = [], 0
                while at < len(texts) and size < CHUNK:
                    held.append(ngrams(texts[at].as_py() or "", order))
                    size += len(held[-1])
                    at += 1
                n = np.array([len(x) for x in held])
                keys, row = np.concatenate(held), np.repeat(np.arange(len(held)), n)
                if shards > 1:
                    mine = _in_shard((keys >> BITS) & ((1 << (2 * BITS)) - 1), shards, shard)
                    keys, row = keys[mine], row[mine]
                logp = np.empty(len(keys))
                of = half[at - len(held) : at][row]
                for half_of_text in (0, 1):
                    own = of == half_of_text
                    logp[own] = scorers[1 - half_of_text].score(keys[own])
                sums[0].append(np.bincount(row, logp, len(held)))
                sums[1].append(np.bincount(row, logp * logp, len(held)))
                sums[2].append(np.bincount(row, minlength=len(held)))
            cat = lambda xs, kind: pa.array(np.concatenate(xs).astype(kind) if xs else np.array([], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], cat(sums[0], "f8"), cat(sums[1], "f8"), cat(sums[2], "i8")], [*batch.schema.names[:-2], "s1", "s2", "symbols"])

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], _half("doc_id"), F.col(f"`{text_col}`")).mapInArrow(run, f"{shape}, s1 double, s2 double, symbols bigint"), shared


def _half(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(2)).cast("int")


def scored(docs: DataFrame, model: DataFrame, text_col: str = "text", order: int = ORDER, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns ``keep`` with nll, spread (standard deviation a symbol) and symbols of each row, by the other half's model.

    ``keep`` names a text: rows equal in it have equal texts.
    """
    keep = keep or ["doc_id"]
    shards = max(1, -(-model.count() * ROW_BYTES // shard_bytes)) if order > 2 else 1
    if shards == 1:
        sums, _ = _partial_sums(docs, text_col, model, order, keep, 1, 0)
    else:
        done: list[DataFrame] = []
        for k in range(shards):  # one shard at a time is held
            part, shared = _partial_sums(docs, text_col, model, order, keep, shards, k)
            done.append(settle_in_small_batches(part))
            shared.unpersist()
        whole = done[0]
        for more in done[1:]:
            whole = whole.unionByName(more)
        # Equal rows come once for each shard and copy.
        totals = whole.groupBy(*keep).agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("symbols").alias("symbols"), (F.count("*") / shards).cast("long").alias("_copies"))
        repeat = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")
        sums = totals.select(*keep, *[(F.col(c) / F.col("_copies")).cast(kind).alias(c) for c, kind in (("s1", "double"), ("s2", "double"), ("symbols", "long"))], repeat).drop("_copy")
    mean = F.col("s1") / F.col("symbols")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("symbols") - mean * mean, F.lit(0.0)))
    return sums.select(*keep, (-mean).alias("nll"), spread.alias("spread"), "symbols")


def judged(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", order: int = ORDER, quantile: float = QUANTILE, sigmas: float = SIGMAS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """doc_id, lang, text_key, nll, perplexity, threshold (of the score less its margin), keep: a row per row of ``docs``."""
    good = settle(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct())
    side = F.broadcast(good) if good.count() <= BROADCAST_LABELS else good
    trusted = docs.join(side, docs["doc_id"] == side["_good"], "left_semi")
    counts = settle_in_small_batches(count_ngrams(trusted.withColumn("_half", _half("doc_id")), text_col, order, "_half"))
    model = train(counts, order)
    lean = docs.select("doc_id", "lang", F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = scored(lean, model, "text", order, ["doc_id", "lang", "text_key"], shard_bytes)
    rows = rows.withColumn("bound", F.col("nll") - sigmas * F.col("spread") / F.sqrt("symbols"))
    rows = settle_in_small_batches(rows)
    marked = rows.join(side, rows["doc_id"] == side["_good"], "left_semi").withColumn("bin", F.ceil(F.col("bound") / BIN))
    bins = marked.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    bins = settle(bins)
    everyone = bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumns({"lang": F.lit(None).cast("string"), "any": F.lit(True)})
    both = bins.withColumn("any", F.lit(False)).unionByName(everyone.select("lang", "bin", "n", "any"))
    upto = Window.partitionBy("any", "lang").orderBy("bin")
    reached = both.withColumns({"at": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("any", "lang"))})
    limits = reached.where(F.col("at") >= quantile * F.col("all")).groupBy("any", "lang").agg((F.min("bin") * BIN).alias("limit"), F.max("all").alias("trusted"))
    limits = settle(limits)
    own = limits.where(f"not any and trusted >= {LEAST_TRUSTED}").select(F.col("lang").alias("_lang"), F.col("limit").alias("_own"))
    general = limits.where("any").select(F.max("limit").alias("_general"))
    judged_rows = rows.join(own, rows["lang"].eqNullSafe(own["_lang"]), "left").join(F.broadcast(general))
    limit = F.coalesce("_own", "_general")
    return judged_rows.select(
        "doc_id", "lang", "text_key", "nll", F.exp("nll").alias("perplexity"), limit.alias("threshold"), (limit.isNull() | (F.col("bound") <= limit)).alias("keep")
    )


def quality_filter(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns as they were."""
    verdicts = judged(docs, labels, text_col)
    out = settle(verdicts.where("not keep").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_key").alias("_key")).distinct())
    keyed = docs.withColumn(spread_name(docs.columns, "_text_key"), F.xxhash64(text_col))
    key = keyed.columns[-1]
    same = (keyed[key] == out["_key"]) & keyed["doc_id"].eqNullSafe(out["_id"]) & keyed["lang"].eqNullSafe(out["_lang"])
    return keyed.join(out, same, "left_anti").select(*docs.columns)

