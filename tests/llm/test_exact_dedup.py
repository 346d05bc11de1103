import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from statewright.llm.exact_dedup import exact_dedup, exact_groups

from .helpers import awkward, empty


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        t = r["text"] or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
    out = Counter()
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out[(m[3], members[0][3], len(members), k == 0)] += 1
    return out


def found(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_groups_equal_brute_force_over_many_levels(spark):
    docs = awkward(spark)
    for block in (7, 1000, 8192):
        assert found(exact_groups(docs, block=block)) == brute(docs.collect())


def test_colliding_digests_are_told_apart(spark):
    docs = awkward(spark)
    weak = exact_groups(docs, block=500, digest=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    assert found(weak) == brute(docs.collect())


def test_rows_that_stay(spark):
    docs = awkward(spark)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    want = sum(n for (_, _, _, k), n in brute(docs.collect()).items() if k)
    assert kept.count() == want
    assert kept.where("doc_id = 2").count() == 1


def test_empty(spark):
    assert exact_groups(empty(spark)).count() == 0
    assert exact_dedup(empty(spark)).count() == 0
