import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statewright.llm.kneser_ney import END, START, SYMBOLS, count_ngrams, discounts, judged, ngrams, quality_filter, scored, symbols, train

from .helpers import awkward, empty, words


class Slow:
    """Interpolated modified Kneser-Ney straight from its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.c = {order: Counter()}
        for t in texts:
            x = [START] * (order - 1) + symbols(t).tolist() + [END]
            self.c[order].update(tuple(x[i : i + order]) for i in range(len(x) - order + 1))
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d = {k: discounts(Counter(v for v in c.values() if v <= 4)) for k, c in self.c.items()}
        self.after = {k: defaultdict(list) for k in self.c}
        for k, c in self.c.items():
            for g, n in c.items():
                self.after[k][g[:-1]].append(n)

    def p(self, g):
        if not g:
            return 1 / SYMBOLS
        k, low = len(g), self.p(g[1:])
        seen = self.after[k].get(g[:-1])
        if not seen:
            return low
        cut = lambda n: self.d[k][min(n, 3) - 1] if n else 0.0
        n = self.c[k][g]
        return (n - cut(n)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * low

    def nll(self, text):
        x = [START] * (self.order - 1) + symbols(text).tolist() + [END]
        got = [-math.log(self.p(tuple(x[i : i + self.order]))) for i in range(len(x) - self.order + 1)]
        return sum(got) / len(got)


def test_packing_of_ngrams():
    assert len(ngrams("", 3)) == 1 and len(ngrams("a b", 3)) == 4
    assert symbols("a  7\n9").tolist() == [97, 32, 48, 32, 48]


def test_symbols_tell_all_texts_apart():
    assert symbols("日本😀語").tolist() == [3824 + (ord(c) >> 12) if i == 0 else ord(c) & 4095 for c in "日本😀語" for i in (0, 1)]
    seen = {tuple(symbols(chr(p)).tolist()) for p in range(200, 0x30000, 7) if not chr(p).isspace() and not 0xD800 <= p < 0xE000}
    assert len(seen) == sum(1 for p in range(200, 0x30000, 7) if not chr(p).isspace() and not 0xD800 <= p < 0xE000)
    assert all(x < SYMBOLS for s in seen for x in s)


@pytest.mark.parametrize("limit", [1 << 26, 4000])
def test_scores_equal_the_definition_for_any_number_of_shards(spark, limit):
    texts = [words(i, 30) for i in range(12)] + ["日本語のテキスト、そして " + words(50, 5), "한국어 텍스트 " * 5]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    halves = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("h")).collect()}
    models = {h: Slow([t for i, t in enumerate(texts) if halves[i] == h], 4) for h in (0, 1)}
    model = train(count_ngrams(docs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "text", 4, "h"), 4)
    got = {r["doc_id"]: r for r in scored(docs, model, "text", 4, shard_bytes=limit).collect()}
    assert len(got) == len(texts)
    assert scored(docs.unionByName(docs.where("doc_id = 3")), model, "text", 4, shard_bytes=limit).where("doc_id = 3").count() == 2
    for i, t in enumerate(texts):
        assert got[i]["nll"] == pytest.approx(models[1 - halves[i]].nll(t), abs=1e-5)
        assert got[i]["symbols"] == len(symbols(t)) + 1


def test_thresholds_and_verdicts_equal_counting(spark):
    """The limit of a language is the least bin that holds the quantile of its trusted rows, or of all of them where it has few."""
    rows = [(i, words(i, 20 + i % 30), ["en", "de", None][i % 3] if i < 105 else "xx") for i in range(110)] + [(500, "QQ %% ## " * 30, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = judged(docs, labelled(spark, [(i, 1, 0) for i in range(110) if i % 7]), quantile=0.9).collect()
    figures = {r["doc_id"]: r for r in got}
    halves = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("h")).collect()}
    good = [r for r in rows if r[0] < 110 and r[0] % 7]
    models = {h: Slow([t for i, t, _ in good if halves[i] == h], 5) for h in (0, 1)}

    def bound(i, t):
        slow = models[1 - halves[i]]
        x = [START] * 4 + symbols(t).tolist() + [END]
        got = [math.log(slow.p(tuple(x[k : k + 5]))) for k in range(len(x) - 4)]
        mean = sum(got) / len(got)
        return -mean - 2 * math.sqrt(max(0, sum(g * g for g in got) / len(got) - mean * mean)) / math.sqrt(len(got))

    bounds = {i: bound(i, t) for i, t, _ in rows}
    own = defaultdict(list)
    for i, _, lang in good:
        own[lang].append(math.ceil(bounds[i] / 0.001))
    pooled = [b for bs in own.values() for b in bs]
    limit = lambda bs: next(b for b in sorted(bs) if sum(x <= b for x in bs) >= 0.9 * len(bs)) * 0.001
    for i, _, lang in rows:
        want = limit(own[lang]) if len(own[lang]) >= 30 else limit(pooled)
        assert figures[i]["threshold"] == pytest.approx(want, abs=0.0011)
        if abs(bounds[i] - want) > 0.002:
            assert figures[i]["keep"] == (bounds[i] <= want)
    assert not figures[500]["keep"]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_stays(spark):
    clean = [(i, words(i, 120), "en", "s", 1) for i in range(120)]
    junk = [(1000 + i, " ".join(w.upper() + "%%!" for w in words(i, 120).split()), "en", "s", 1) for i in range(10)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = quality_filter(docs, labelled(spark, [(i, 1, 0) for i in range(60)] + [(1000, 0, 0)]))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {1000 + i for i in range(10)} and len(ids) >= 115


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = labelled(spark, [(9, 1, 0), (9, 0, 0), (None, 1, 0), (6, 1, None)])
    rows = judged(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["perplexity"] > 0 for r in rows)
    assert quality_filter(docs, labels).columns == docs.columns
    none = judged(docs, labelled(spark, []))
    assert none.where("not keep").count() == 0 and none.count() == docs.count()
    assert judged(empty(spark), labels).count() == 0
