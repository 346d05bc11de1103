import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statewright.llm.packing import best_fit, pack_documents, pack_items

from .helpers import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows):
    """No overlaps or gaps; returns the number of sequences."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins)


def test_pieces_equal_the_tokenizer(spark):
    tok = Tokenizer.from_file(PATH)
    docs = awkward(spark).select("doc_id", "text", "lang")
    extra = ["it's WE'LL don't <|endoftext|> a<|endoftext|>b", "J̌ABC T̈ x", "a...b,,c. d, e!", "ẞ İ ΣΣ", "1.5, x2. é. a b c", "<|ENDOFTEXT|>"]
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(extra)], "doc_id long, text string, lang string"))
    rows = pack_documents(docs, PATH).collect()
    want = defaultdict(int)
    for d in docs.collect():
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], dtype="<u4")
            want[(d["doc_id"], k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    got = defaultdict(int)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    assert got == want
    check_places(rows)


@pytest.mark.parametrize("group", [200, 100_000])
def test_rounds_fill_bins(spark, group):
    rng = random.Random(5)
    sizes = [min(2048, max(1, int(rng.lognormvariate(5.8, 1)))) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    places = {r["item"]: r for r in pack_items(items, group_items=group).collect()}
    assert len(places) == len(sizes)
    n = check_places([{"sequence_id": p["sequence_id"], "offset": p["offset"], "length": sizes[i]} for i, p in places.items()])
    assert n <= 1.03 * -(-sum(sizes) // 2048) + 1


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fill = best_fit([6, 5, 4, 3], 10)
    assert sorted(fill) == [8, 10] and bins[0] == bins[2]


def test_empty(spark):
    assert pack_documents(empty(spark), PATH).count() == 0
