"""Vectorised text features for the classifiers: shape statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import runs, slices, span_hashes, utf8

SHAPE = (
    "upper", "lower", "digit", "space", "newline", "bang", "pipe", "mark", "other_punct", "high_bytes",
    "words_log", "word_mean", "word_long", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "sentence_mean", "word_end_mark", "upper_words", "short_words", "has_text",
)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_SPACE = _table(" \t\n\x0b\x0c\r")
_MARK = _table("#$%&*@^~=<>{}[]\\/_+")
_PUNCT = _table(".,;:?'\"()-")
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def _distinct(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many distinct keys, and how often its most frequent key stands."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(keys):
        order = np.lexsort((keys, doc))
        d, k = doc[order], keys[order]
        new = np.ones(len(k), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(k)))
        distinct = np.bincount(d[first], minlength=n).astype(float)
        np.maximum.at(top, d[first], size)
    return distinct, top


def shape(texts: pa.Array) -> np.ndarray:
    """A row of ``SHAPE`` for each text; null and empty texts have all zeros."""
    parts = []
    for begin, end in slices(texts):
        data, at = utf8(texts.slice(begin, end - begin))
        n = end - begin
        size = np.maximum(np.diff(at), 1).astype(float)
        space = _SPACE[data]
        share = {k: _per_text(t[data], at) / size for k, t in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("mark", _MARK), ("other_punct", _PUNCT), ("high_bytes", _HIGH))}
        share["space"] = _per_text(space, at) / size
        share["newline"] = _per_text(data == 10, at) / size
        share["bang"], share["pipe"] = _per_text(data == 33, at) / size, _per_text(data == 124, at) / size
        starts, ends, doc = runs(~space, at)
        count = np.bincount(doc, minlength=n).astype(float)
        least = np.maximum(count, 1)
        length = (ends - starts).astype(float)
        keys = span_hashes(_FOLD[data], starts, ends)
        distinct, top = _distinct(doc, keys, n)
        pair_doc = doc[:-1][doc[:-1] == doc[1:]] if len(doc) else doc
        with np.errstate(over="ignore"):
            pairs = (keys[:-1] * np.uint64(31) + keys[1:])[doc[:-1] == doc[1:]] if len(doc) else keys
        pair_distinct, _ = _distinct(pair_doc, pairs, n)
        pair_count = np.bincount(pair_doc, minlength=n).astype(float)
        l_starts, l_ends, l_doc = runs(data != 10, at)
        line_distinct, _ = _distinct(l_doc, span_hashes(data, l_starts, l_ends), n)
        line_count = np.bincount(l_doc, minlength=n).astype(float)
        last = data[ends - 1] if len(ends) else data
        mean = lambda values: np.bincount(doc, values, minlength=n) / least
        stops = np.bincount(doc, np.isin(last, [46, 63, 33]), minlength=n)
        share |= {
            "words_log": np.log1p(count), "word_mean": mean(length) / 10, "word_long": mean(length > 20), "distinct_words": distinct / least, "top_word": top / least,
            "repeated_pairs": 1 - pair_distinct / np.maximum(pair_count, 1), "repeated_lines": 1 - line_distinct / np.maximum(line_count, 1), "sentence_mean": np.log1p(count / (stops + 1)),
            "word_end_mark": mean(_MARK[last] | (last == 33) | (last == 124)), "upper_words": mean(_UPPER[data[starts]] & _UPPER[last]) if len(starts) else count, "short_words": mean(length <= 3), "has_text": np.ones(n),
        }
        rows = np.stack([share[k] for k in SHAPE], 1)
        rows[np.diff(at) == 0] = 0
        parts.append(rows)
    return np.concatenate(parts) if parts else np.empty((0, len(SHAPE)))


def squared(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x, np.sqrt(np.abs(x))], 1)


def batches_with(batches: Iterator[pa.RecordBatch], value, name: str) -> Iterator[pa.RecordBatch]:
    """Each batch (id, text) as (id, ``name``): a double from ``value`` of the texts."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value(batch.columns[-1]), pa.float64())], names=[*batch.schema.names[:-1], name])
