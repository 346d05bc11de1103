"""URL filtering: curated prefix rules, and association rules mined where none fits.

A curated rule names a host (and all its subdomains) and the beginning of a
path.  The urls that such rules judge are the labelled ones: their tokens (host
labels, path words, query keys) together with the verdict are mined by Spark's
FP-growth.  Before that, tokens that always occur together in labelled urls (the
labels of one domain, say) count as one, and tokens of nearly all of them, which
tell nothing, go: n such tokens would be in 2^n itemsets.  Rules from token combinations to a verdict are pruned by support and
confidence, and a longer combination goes where a part of it is as confident.
They match urls by an inverted index: token to rules, joined with the urls'
tokens; a rule fits if as many of its tokens are found as it has.  Each distinct
set of tokens is matched once.

Everything is DataFrame, SQL and Spark ML operations; nothing is collected.

How a url without a curated rule is judged: blocked if a mined rule for block
fits, at the least confidence or more, and none for allow is as confident;
allowed otherwise.

Defined results
    Null urls and those without ``://`` have empty host and path, no rule, no
    tokens, and are allowed.  Repeated rows are judged alike.  If no url is
    labelled, or there are no mined rules, all others are allowed.  Urls are read
    whole, however long.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# The curated rules (verdict, host, beginning of the path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
#: A token in this share of the labelled urls tells nothing.
EVERYWHERE = 0.99
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found: Column | None = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens, sorted: h: host labels, p: path words without digits, q: names of query parameters."""
    words = lambda text, by, mark: F.transform(F.filter(F.split(text, by), lambda w: w.rlike("[^0-9]") & (F.length(w) > 1)), lambda w: F.concat(F.lit(mark), w))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.regexp_replace(query, "=[^&]*", "")
    path = F.regexp_replace(path_of(url), "[0-9]+", "")
    return F.array_sort(F.array_distinct(F.concat(words(host_of(url), "[.]", "h:"), words(path, "[/._-]+", "p:"), words(keys, "&", "q:"))))


def token_names(labelled: DataFrame, support: float) -> DataFrame:
    """token, name of the tokens of enough labelled urls: the least of those that occur in the same ones; null for tokens of nearly all.

    Two tokens are taken to occur in the same urls if their urls' digests have
    equal counts and sums.
    """
    n = labelled.count()
    rows = labelled.groupBy("tokens").agg(F.count("*").alias("n"))
    digest = F.xxhash64("tokens").cast("decimal(38,0)")
    seen = rows.select(F.explode("tokens").alias("token"), "n", digest.alias("d")).groupBy("token").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where(F.col("n") >= support * n)
    seen = settle(seen)  # at most as many as tokens a url, over the support
    names = seen.groupBy("n", "d").agg(F.min("token").alias("name"))
    told = seen.join(names, ["n", "d"])
    return settle(told.select("token", F.when(F.col("n") < EVERYWHERE * n, F.col("name")).alias("name")))


def renamed(token_sets: DataFrame, names: DataFrame) -> DataFrame:
    """The distinct ``tokens`` with ``items``: the names of those that have one."""
    side = F.broadcast(names) if names.count() <= BROADCAST_RULES else names
    spread = token_sets.select("tokens", F.explode("tokens").alias("token")).join(side, "token").where("name is not null")
    return spread.groupBy("tokens").agg(F.sort_array(F.collect_set("name")).alias("items"))  # no more than the url has tokens


def mined_rules(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, tokens, verdict, confidence from rows (tokens, verdict)."""
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("= "), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("= ") & ~F.exists("antecedent", lambda t: t.startswith("= ")))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 3, 10).alias("verdict"), "confidence")
    rules = settle(rules)
    # A combination adds nothing if leaving one token out is as confident.
    shorter = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("out"))
    shorter = shorter.select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("out")).alias("part"))
    part = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("had"))
    idle = shorter.join(part, ["part", "verdict"]).where("had >= confidence").select("tokens", "verdict").distinct()
    return settle(rules.join(idle, ["tokens", "verdict"], "left_anti").withColumn("rule_id", F.monotonically_increasing_id()))


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, mined for each distinct token set that a rule for block decides."""
    index = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    spread = token_sets.select("tokens", F.explode("tokens").alias("token"))
    hits = spread.join(index, "token").groupBy("tokens", "rule_id", "verdict", "confidence", "need").agg(F.count("*").alias("have")).where("have = need")
    best = lambda v: F.max(F.when(F.col("verdict") == v, F.col("confidence")))
    sides = hits.groupBy("tokens").agg(best("block").alias("block"), best("allow").alias("allow"))
    return sides.where("block is not null and (allow is null or allow < block)").select("tokens", F.lit("block").alias("mined"))


def mined_verdicts(labelled: DataFrame, token_sets: DataFrame, support: float, confidence: float) -> DataFrame:
    """tokens, mined of the distinct ``token_sets`` (tokens) that rules mined from ``labelled`` (tokens, verdict) block."""
    names = token_names(labelled, support)
    known = renamed(labelled.select("tokens").distinct(), names)
    baskets = labelled.join(known, "tokens", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("tokens"), "verdict")
    rules = mined_rules(baskets, support, confidence)
    asked = settle(renamed(token_sets, names))
    found = matched(asked.select(F.col("items").alias("tokens")).distinct(), rules).withColumnRenamed("tokens", "items")
    return asked.join(found, "items").select("tokens", "mined")


def _judged(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url_tokens(url), F.array().cast("array<string>")).alias("tokens"))
    return rows.withColumn("hit", curated(F.col("host"), F.col("path"))).select("page_id", "host", "path", "tokens", "hit.rule", F.col("hit.verdict").alias("given"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rows = _judged(pages, id_col, url_col)
    labelled = rows.where("given is not null").select("tokens", F.col("given").alias("verdict"))
    found = settle(mined_verdicts(labelled, rows.where("given is null").select("tokens").distinct(), support, confidence))
    judged = rows.join(found, ["tokens"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"))


def held_out_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, parts: int = 5) -> DataFrame:
    """given, mined, n: what curated rules say of one host in ``parts``, and what rules mined from the other hosts do."""
    rows = _judged(pages, id_col, url_col).where("given is not null").withColumn("out", F.pmod(F.xxhash64("host"), F.lit(parts)) == 0)
    known, asked = rows.where("not out").select("tokens", F.col("given").alias("verdict")), rows.where("out")
    found = settle(mined_verdicts(known, asked.select("tokens").distinct(), support, confidence))
    both = asked.join(found, ["tokens"], "left").select("given", F.coalesce("mined", F.lit("allow")).alias("mined"))
    return both.groupBy("given", "mined").agg(F.count("*").alias("n"))
