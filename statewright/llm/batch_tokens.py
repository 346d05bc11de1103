"""Token ids of whole Arrow batches: words are split, looked up and put together as arrays.

The words of a batch are cut and numbered by Arrow's kernels; only words that
occur in a batch for the first time meet Python, in the remembered words of
:mod:`.packing`.  Rows that may spell a special token, or hold combining marks
(which change how a letter before them is folded), go that module's way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .fill_middle import buffers, runs
from .packing import WordIds

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with the bytes of combining marks or the beginning of a special token."""
    at = np.concatenate([np.flatnonzero((data == 0xCC) | (data == 0xCD)), np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))])
    return np.unique(np.searchsorted(offsets, at, side="right") - 1)


def sliced(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def batch_ids(known: WordIds, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after another, each row's end id included, and where each row begins and the last one ends.

    ``texts``: a binary column, null as empty.
    """
    data, offsets = buffers(texts)
    n, end = len(offsets) - 1, np.array([end_id], dtype="<u4").tobytes()
    odd = odd_rows(data, offsets)
    special = known.of([bytes(data[offsets[r] : offsets[r + 1]]) for r in odd.tolist()])
    folded = _LOWER[data]
    for r in odd.tolist():
        folded[offsets[r] : offsets[r + 1]] = ord(" ")
    strings = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(folded))
    lists = pc.ascii_split_whitespace(strings)
    encoded = lists.flatten().dictionary_encode()
    words = sliced(*buffers(encoded.dictionary.cast(pa.large_binary())))
    found = list(map(known.get, words))
    if None in found:
        known.learn({w for w, f in zip(words, found, strict=True) if f is None})
        found = [known[w] if f is None else f for w, f in zip(words, found, strict=True)]
    # After the words of a row comes one more: the end id, or all ids of a row that went the other way.
    last = np.full(n, len(found))
    last[odd] = len(found) + 1 + np.arange(len(odd))
    pieces = [*found, end, *(s + end for s in special)]
    stops = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    which = np.insert(encoded.indices.to_numpy().astype(np.int32), stops[1:], last)
    ids = np.frombuffer(b"".join(pieces), dtype="<u4")
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    begins = np.cumsum(lengths) - lengths
    each = lengths[which]
    upto = np.cumsum(each)
    taken = ids[np.arange(upto[-1] if n else 0) + np.repeat(begins[which] - upto + each, each)]
    return taken, np.concatenate([[0], upto])[np.concatenate([[0], stops[1:] + np.arange(1, n + 1)])]


__all__ = ["batch_ids", "runs"]
