"""Toxicity by weak supervision.

Voters are words of a lexicon, words and word beginnings mined from labelled
rows, and patterns; a voter says toxic or abstains, and a text on which all
abstain is one vote for harmless.  The label itself is a voter of high but not
full accuracy.  A generative model is fitted to the votes by expectation
maximisation: class balance and each voter's rate in either class.  Voters that
fire together beyond what the classes explain count as less than one vote each
(their weight falls with the sum of their correlations, as the model's classes
leave them).  Its posterior labels train a linear classifier on the presence of
mined words, word beginnings and patterns, which scores every whole text.  Few
rows of a class leave its scores low, so the intercept is set where scores of
rows not fitted on (``FOLDS`` parts, each scored by a fit on the others) tell the
classes apart best.

The model is fitted on a bounded, documented sample: ``SAMPLE_ROWS`` labelled
rows, the least by a digest of the id, of those whose crc32(id as text) mod 5
is not 0.  Scoring is local to a row: no shuffle, no cap, every row and text.

Defined results
    Null text counts as empty and gets the score of a text with no feature.
    Without usable labels, or with one class only, every row gets the share of
    toxic labels (0 without labels).  Labels of null id are ignored; of several
    labels of an id the greatest counts.  Repeated rows get equal scores, rows of
    null id their text's.  Texts are read whole, however long.  An empty table
    gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SAMPLE_ROWS = 20_000
FEATURES = 4_000
VOTERS = 200
LEAST_SEEN = 3
STARTS = (3, 4, 5, 6, 7, 8)
LABEL_ACCURACY = 0.98
FOLDS = 3
WORD = re.compile(r"[^\W\d_]+")

# A small lexicon of insults, and patterns of insulting phrases.
LEXICON = ["idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "garbage", "vermin", "filth"]
PATTERNS = [r"\byou (?:are|re) (?:a|an|so) (?:idiot|moron|loser|clown|stupid)", r"\bshut up\b", r"\bgo to hell\b", r"\bi hate you\b", r"\bkill yourself\b"]


def features(text: str) -> set[str]:
    """Distinct words in lower case, and their beginnings marked by a star."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for k in STARTS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """toxic, text of the bounded sample."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    chosen = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")))
    texts = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(F.broadcast(chosen), texts["_doc"] == chosen["_id"]).select(F.col("_toxic").alias("toxic"), "text")


def _feature_counts(sample: DataFrame, only: set[str] | None, toxic: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = features(text or "")
                for f in found if only is None else found & only:
                    counts[f] = counts.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["feature", "n"])

    rows = sample.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "feature string, n bigint")
    return rows.groupBy("feature").agg(F.sum("n").alias("n"))


def mined(sample: DataFrame, limit: int) -> tuple[list[str], dict[str, tuple[int, int]]]:
    """The ``limit`` features that tell the classes apart best, and their counts in toxic and harmless rows."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, harmless = sizes.get(1, 0), sizes.get(0, 0)
    often = _feature_counts(sample, None, 1).where(F.col("n") >= LEAST_SEEN)
    often = {r["feature"]: r["n"] for r in often.orderBy(F.desc("n"), "feature").limit(25 * limit).collect()}
    other = {r["feature"]: r["n"] for r in _feature_counts(sample, set(often), 0).collect()}

    def strength(f: str) -> float:
        p, q = (often[f] + 0.5) / (toxic + 1), (other.get(f, 0) + 0.5) / (harmless + 1)
        return (p - q) * math.log(p / q)

    ranked = sorted(often, key=lambda f: (-strength(f), f))[:limit]
    return ranked, {f: (often[f], other.get(f, 0)) for f in ranked}


def presence(sample: DataFrame, names: list[str], patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and the presence of features and patterns as row starts and column numbers."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p) for p in patterns]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = sorted(index[f] for f in features(text or "") & index.keys())
                low = (text or "").lower()
                rows.append(found + [len(index) + i for i, p in enumerate(compiled) if p.search(low)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "found"])

    got = sample.select("toxic", "text").mapInArrow(run, "toxic int, found array<int>").toPandas()
    # Order of rows must not matter for the fit: sort by content.
    rows = sorted(zip(got["toxic"].tolist(), (tuple(x) for x in got["found"]), strict=True))
    labels = np.array([r[0] for r in rows], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int64)
    columns = np.array([c for r in rows for c in r[1]], dtype=np.int64)
    return labels, starts, columns


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior probability of toxic per row from 0/1 votes (rows, voters), and what was estimated.

    ``labels`` are 0, 1, or -1 where a row has none.
    """
    n, m = votes.shape
    known = labels >= 0
    share = float(labels[known].mean()) if known.any() else 0.1
    fired = votes.any(axis=1)
    post = np.where(known, np.where(labels == 1, 0.9, 0.1), np.where(fired, 0.6, 0.1))
    weight = np.ones(m)
    stats: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        t, h = post.sum(), (1 - post).sum()
        share = t / n
        on_toxic = (post @ votes + 0.1) / (t + 0.2)
        on_harmless = ((1 - post) @ votes + 0.1) / (h + 0.2)
        # Correlations left within the classes: voters that fire together share their weight.
        rest = votes - np.outer(post, on_toxic) - np.outer(1 - post, on_harmless)
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / n / np.outer(scale, scale)
        weight = 1 / np.maximum(1.0, (np.abs(correlation) * (np.abs(correlation) > 0.2)).sum(axis=1))
        yes = np.log(on_toxic / on_harmless) * weight
        no = np.log((1 - on_toxic) / (1 - on_harmless)) * weight
        odds = math.log(share / (1 - share)) + votes @ (yes - no) + no.sum()
        gold = math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
        odds = odds.clip(-8, 8) + np.where(known, np.where(labels == 1, gold, -gold), 0.0)
        new = 1 / (1 + np.exp(-odds.clip(-30, 30)))
        moved, post = float(np.abs(new - post).max()), new
        stats = {"share": np.array(share), "on_toxic": on_toxic, "on_harmless": on_harmless, "correlation": correlation, "weight": weight}
        if moved < 1e-4:
            break
    return post, stats


def linear_fit(starts: np.ndarray, columns: np.ndarray, width: int, target: np.ndarray, penalty: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model on row-normalised presence, by accelerated gradient steps."""
    rows = np.repeat(np.arange(len(target)), np.diff(starts))
    w, b = np.zeros(width), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    vw, vb = w.copy(), b
    seen = np.bincount(columns, minlength=width) + 1.0
    step = 4.0 / np.sqrt(seen.max())
    scale = np.sqrt(seen.max() / seen)  # rare features take longer steps
    for k in range(rounds):
        z = np.bincount(rows, vw[columns], len(target)) + vb
        error = 1 / (1 + np.exp(-z.clip(-30, 30))) - target
        gradient = np.bincount(columns, error[rows], width) / len(target) + penalty * vw / len(target)
        nw, nb = vw - step * scale * gradient, vb - step * error.mean()
        momentum = k / (k + 3)
        vw, vb, w, b = nw + momentum * (nw - w), nb + momentum * (nb - b), nw, nb
    return w, float(b)


def best_cut(odds: np.ndarray, target: np.ndarray) -> float:
    """The log odds that tell ``target`` (above 0.5) from the rest with the greatest F1: the middle of the widest such gap."""
    order = np.argsort(odds, kind="stable")
    values, hits = odds[order], (target[order] > 0.5).astype(np.int64)
    if hits.all() or not hits.any():
        return 0.0
    found = hits.sum() - np.concatenate([[0], np.cumsum(hits)])  # above the cut before each row
    above = len(hits) - np.arange(len(hits) + 1)
    score = 2 * found / np.maximum(1, above + hits.sum())
    gaps = np.concatenate([[0.0], np.diff(values), [0.0]])
    best = max(range(len(score)), key=lambda i: (round(float(score[i]), 9), gaps[i]))
    return float((values[best - 1] + values[best]) / 2) if 0 < best < len(values) else 0.0


def cross_fitted(starts: np.ndarray, columns: np.ndarray, width: int, target: np.ndarray) -> np.ndarray:
    """Log odds of each row by a fit on the other folds' rows."""
    fold, sizes = np.arange(len(target)) % FOLDS, np.diff(starts)
    rows = np.repeat(np.arange(len(target)), sizes)
    out = np.zeros(len(target))
    for k in range(FOLDS):
        inside = fold != k
        w, b = linear_fit(np.concatenate([[0], np.cumsum(sizes[inside])]), columns[inside[rows]], width, target[inside])
        out[~inside] = (np.bincount(rows, w[columns], len(target)) + b)[~inside]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], list[float], float]:
    """Weights of features and of patterns, and the intercept."""
    sample = settle(training_rows(docs, labels, id_col, text_col, rows))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        share = 1.0 if sizes.get(1) else 0.0
        return {}, [0.0] * len(PATTERNS), 8.0 if share else -8.0
    names, counts = mined(sample, FEATURES)
    names += [w for w in LEXICON if w not in counts]
    gold, starts, columns = presence(sample, names, PATTERNS)
    toxic, harmless = int((gold == 1).sum()), int((gold == 0).sum())
    precise = [f for f, (a, b) in counts.items() if a / toxic > 8 * (b + 0.5) / harmless][: VOTERS - len(LEXICON) - len(PATTERNS)]
    chosen = list(dict.fromkeys([*LEXICON, *precise]))
    voter_of = np.full(len(names) + len(PATTERNS), -1)
    for i, f in enumerate(chosen):
        voter_of[names.index(f)] = i
    voter_of[len(names) :] = len(chosen) + np.arange(len(PATTERNS))
    votes = np.zeros((len(gold), len(chosen) + len(PATTERNS) + 1))
    at = np.repeat(np.arange(len(gold)), np.diff(starts))
    is_vote = voter_of[columns] >= 0
    votes[at[is_vote], voter_of[columns[is_vote]]] = 1
    votes[:, -1] = ~votes[:, :-1].any(axis=1)
    post, _ = label_model(votes, gold)
    width = len(names) + len(PATTERNS)
    weights, intercept = linear_fit(starts, columns, width, post)
    intercept -= best_cut(cross_fitted(starts, columns, width, post), post)
    return {f: float(w) for f, w in zip(names, weights[: len(names)], strict=True) if w}, weights[len(names) :].tolist(), intercept


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, pattern_weights, base = shared.value
        compiled = [(re.compile(p), w) for p, w in zip(PATTERNS, pattern_weights, strict=True) if w]
        whole = {f: w for f, w in weight.items() if not f.endswith("*")}
        begins = {k: {f[:-1]: w for f, w in weight.items() if f.endswith("*") and len(f) == k + 1} for k in STARTS}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                low = (text or "").lower()
                words = set(WORD.findall(low))
                total = base + math.fsum(whole[w] for w in words & whole.keys()) + math.fsum(w for p, w in compiled if p.search(low))
                for k, known in begins.items():
                    if known:
                        total += math.fsum(known[s] for s in {w[:k] for w in words if len(w) > k} & known.keys())
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
            found = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def in_held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
