import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from statewright.llm import curve_packing
from statewright.llm.batch_tokens import batch_ids
from statewright.llm.curve_packing import curve_keys, hilbert, pack_along_curve, pieces_of, tail_bounds, tokenised
from statewright.llm.packing import word_ids

from .helpers import awkward, empty, words

PATH = public_tokenizers.path("word_bpe_49k.json")
EXTRA = ["it's WE'LL don't <|endoftext|> a<|endoftext|>b", "J̌ABC T̈ x", "a...b,,c. d, e!", "ẞ İ ΣΣ", "1.5, x2. é. a b c", "<|ENDOFTEXT|>", "a <| b", "\x0b\x0c x\x1cy z", "日本 語"]


def padding(lengths, capacity=4096):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_meets_each_cell_once_and_steps_to_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    along = cells[np.argsort(keys)]
    assert np.all(np.abs(np.diff(along, axis=0)).sum(axis=1) == 1)


def test_batches_equal_the_tokenizer():
    tok, known = Tokenizer.from_file(PATH), word_ids(PATH)
    texts = [None, "", " ", *EXTRA, "x", words(3, 500), *(words(i, 7) for i in range(50)), None]
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for part in (column, column.slice(3, 20), column.slice(0, 1), column.slice(len(texts), 0)):
        ids, bounds = batch_ids(known, part, 2)
        want = [tok.encode((v.as_py() or b"").decode(), add_special_tokens=False).ids + [2] for v in part]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_words_of_any_kind_equal_the_tokenizer():
    tok, known, rng = Tokenizer.from_file(PATH), word_ids(PATH, 50), np.random.default_rng(8)
    letters = list("abcxyzABCéüßÉÑªºµĲŉŁłİıαя") + ["'", "'s", "'ll", ".", ",", "***", "!?", "$", "<", ">", "1", "²", "½", "…", "—", "日", "́", "n", "e", "s"]
    texts = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(4000)]
    column = pa.array([t.encode() for t in texts], pa.binary())
    for part in (column.slice(0, 1500), column.slice(1000)):
        ids, bounds = batch_ids(known, part, 2)
        want = [[*tok.encode(v.as_py().decode(), add_special_tokens=False).ids, 2] for v in part]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
        assert known.of([v.as_py() for v in part]) == [np.array(w[:-1], dtype="<u4").tobytes() for w in want]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_cover_each_document_once(spark, capacity):
    tok = Tokenizer.from_file(PATH)
    docs = awkward(spark).unionByName(awkward(spark).limit(0)).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(EXTRA)] + [(500 + i, "same words in every copy") for i in range(300)], "doc_id long, text string"))
    rows = pack_along_curve(docs, PATH, capacity=capacity).collect()
    ids = defaultdict(list)
    for d in docs.collect():
        ids[d["doc_id"]].append(tok.encode(d["text"] or "", add_special_tokens=False).ids + [2])
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"], r["doc_tokens"]].append(r)
    want = Counter((i, len(x)) for i, copies in ids.items() for x in copies)
    assert sum(r["length"] for r in rows) == sum(len(x) for copies in ids.values() for x in copies)
    for key, pieces in own.items():
        assert sum(p["length"] for p in pieces) == key[1] * want[key]
        starts = Counter(p["start"] for p in pieces)
        assert starts[0] == want[key]
        for p in pieces:
            crcs = {zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()) for x in ids[key[0]] if len(x) == key[1]}
            assert p["ids_crc32"] in crcs
    assert set(own) == set(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    fills = []
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        fills.append(end)
    assert max(fills) <= capacity and padding(fills, capacity) == 0
    assert sum(f < capacity for f in fills) <= capacity.bit_length()


def test_cuts_of_the_run():
    for total in (0, 1, 63, 64, 65, 1000, 4095):
        tail = tail_bounds(total, 64)
        assert tail[0] == total - total % 64 and tail[-1] == total
        got = [(s, n, q, o) for s, n, q, o in pieces_of(0, total, 64, tail)]
        assert sum(n for _, n, _, _ in got) == total and padding([n for _, n, _, _ in got], 64) == 0
        assert [q for _, _, q, _ in got] == list(range(len(got)))


def test_neighbours_resemble_each_other(spark):
    """Documents of five vocabularies: neighbours along the curve share theirs far more often than by chance."""
    rng = np.random.default_rng(4)
    tongues = [[w for w in words(seed, 60).split()] for seed in range(5)]
    rows = [(i, " ".join(rng.choice(tongues[i % 5], 120))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    points = tokenised(docs, PATH, "doc_id", "text", 2, 4).cache()
    keys = {r["item"]: r["key"] for r in curve_keys(points).collect()}
    order = [r["doc_id"] for r in sorted(points.select("item", "doc_id").collect(), key=lambda r: (keys[r["item"]], r["item"]))]
    same = np.mean([a % 5 == b % 5 for a, b in itertools.pairwise(order)])
    assert same > 0.7


def test_equal_texts_have_equal_keys_and_long_ones_are_batched(spark, monkeypatch):
    docs = spark.createDataFrame([(i, words(i % 3, 80)) for i in range(12)], "doc_id long, text string")
    points = tokenised(docs, PATH, "doc_id", "text", 2, 4).cache()
    keys = {r["item"]: r["key"] for r in curve_keys(points).collect()}
    assert len(set(keys.values())) == 3
    before = sorted(map(tuple, points.select("doc_id", "ids").collect()))
    monkeypatch.setattr(curve_packing, "TOGETHER", 10)
    assert sorted(map(tuple, tokenised(docs, PATH, "doc_id", "text", 2, 4).select("doc_id", "ids").collect())) == before


def test_empty(spark):
    assert pack_along_curve(empty(spark), PATH).count() == 0
    with pytest.raises(ValueError, match="63 bits"):
        pack_along_curve(empty(spark), PATH, dims=8, bits=8)
