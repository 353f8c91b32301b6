"""Periodic runs by internal pattern matching.

A run is a stretch of words with smallest period q, at least max(6, 4 q) long, that no neighbouring word extends. The words of
many documents stand in one sequence as numbers that no two documents share, so nothing matches from one document to another.
A suffix array of it comes from prefix doubling, which at length 2^k also gives the range of suffixes that begin with each
dyadic block (one that starts at a multiple of its length). A wavelet tree over the suffix array answers, for each
block, its next and its last occurrence (range successor and predecessor). A run of period q <= 2^k < 2 q holds a whole block
whose nearest occurrence on one side lies in the run too, and since the block is no shorter than q, its
distance is q itself: occurrences inside a run are a progression of difference q. So each block gives at most two candidate periods, and a candidate stretched as
far as its words repeat is a run with smallest period q, or too short.

Memory: some ten numbers a word of the sequence, which is BATCH_WORDS long or one document, if that is longer.

Defined results: a null text has no words; a null doc_id has no extension; without runs the four columns of the greatest are
null and both digests are of what is there (no lines; all words); repeated rows are rows each; an empty table gives an empty table; very long
texts are read whole, their words some megabytes at a time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 200_000
LEAST, REPEATS = 6, 4
#: Periods whose stretches are read off all words at once; those of longer periods are followed from their blocks.
SHORT = 8
SLICE = 1 << 20
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


class Wavelet:
    """Bit planes of a sequence of numbers below n, highest first; each is stably parted by its bit."""

    def __init__(self, values: np.ndarray, n: int) -> None:
        self.planes = []
        for bit in reversed(range(max(1, int(n - 1).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.planes.append((bit, packed, before, len(values) - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of values[low:high] are less than x."""
        out = np.zeros(len(low), np.int64)
        for bit, packed, before, zeros in self.planes:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            one = (x >> bit & 1).astype(bool)
            out += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return out

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[low:high]."""
        out = np.zeros(len(low), np.int64)
        for bit, packed, before, zeros in self.planes:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            less = (high - b) - (low - a)
            one = k >= less
            out |= one.astype(np.int64) << bit
            k = np.where(one, k - less, k)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return out


def suffixes(words: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The suffix array of words (numbers from 0), and for each length 2^k the ranges (low, high) in it of the suffixes that begin with the
    blocks at multiples of 2^k. Lengths at which no block occurs twice are left out."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    sorted_ = words[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    count = np.empty(n, np.int64)  # by rank: suffixes that share it
    count[starts] = sizes
    blocks = []
    open_ = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # places in order whose suffix is not alone
    length = 1
    while len(open_):
        low = rank[: n - length + 1 : length].copy()
        blocks.append((low, low + count[low]))
        at = order[open_]
        after = at + length
        beyond = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[at]
        by = np.lexsort((beyond, group))
        at, group, beyond = at[by], group[by], beyond[by]
        order[open_] = at
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat(open_[starts], sizes)
        count[open_[starts]] = sizes
        open_ = open_[np.repeat(sizes, sizes) > 1]
        length *= 2
    return order, blocks


def candidates(words: np.ndarray) -> dict[int, np.ndarray]:
    """Period to the sorted places at which a block stands that comes again so many words later."""
    order, blocks = suffixes(words)
    tree = None
    found = defaultdict(list)
    for k, (low, high) in enumerate(blocks):
        length = 1 << k
        place = np.arange(len(low), dtype=np.int64) * length
        asked = high - low > 1
        if k < 2:  # only a neighbour can be near enough: blocks without an equal one there need not ask
            same = low[1:] == low[:-1]
            asked &= np.concatenate([[False], same]) | np.concatenate([same, [False]])
        low, high, place = low[asked], high[asked], place[asked]
        if not len(place):
            continue
        tree = tree or Wavelet(order, len(words))
        less = tree.below(low, high, place)
        for later in (True, False):
            has = less + 1 < high - low if later else less > 0
            other = tree.smallest(low[has], high[has], less[has] + (1 if later else -1))
            gap = np.abs(other - place[has])
            near = (gap <= length) & (2 * gap > length)
            for q in np.unique(gap[near]).tolist():
                found[q].append(np.minimum(other, place[has])[near & (gap == q)])
    return {q: np.unique(np.concatenate(places)) for q, places in found.items()}


def _stretch(words: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The first and the end of the places i around at with words[i] == words[i + q]."""
    end, step = at, q
    while end + q < len(words):
        a, b = words[end : min(end + step, len(words) - q)], words[end + q : end + q + step]
        differ = a != b
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = end + len(a), step * 2
    first, step = at, q
    while first > 0:
        low = max(0, first - step)
        differ = (words[low:first] != words[low + q : first + q])[::-1]
        if differ.any():
            first -= int(differ.argmax())
            break
        first, step = low, step * 2
    return first, end


def find_runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    words = np.asarray(words, np.int64)
    out = []
    for q, places in (candidates(words) if len(words) else {}).items():
        if q <= SHORT:
            same = np.concatenate([[False], words[:-q] == words[q:], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            first, end = edges[::2], edges[1::2]
            held = np.unique(np.searchsorted(first, places, side="right") - 1)
            out += [(a, b - a + q, q) for a, b in zip(first[held].tolist(), end[held].tolist(), strict=True)]
        else:
            past = -1
            for at in places.tolist():
                if at >= past:
                    first, past = _stretch(words, at, q)
                    out.append((first, past - first + q, q))
    runs = np.array(sorted(x for x in out if x[1] >= max(LEAST, REPEATS * x[2])), np.int64).reshape(-1, 3)
    return runs


def numbered(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers by first appearance, and the words themselves."""
    raw = (text or "").encode()
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    parts, at = [], 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\f\r":  # a slice ends where a word ends
            end += 1
        parts.append(np.fromiter(map(known.__getitem__, raw[at:end].split()), np.int64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(known)


def extended(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """For ids whose digest is divisible by ten: the words from place a on repeat the p words there."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _row(doc_id: int | None, words: np.ndarray, vocabulary: list[bytes], runs: np.ndarray) -> dict:
    best = None
    lines = hashlib.sha256()
    for start, length, q in runs.tolist():  # by start, then period: a tie stays with the first
        lines.update(b"%d,%d,%d\n" % (start, length, q))
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = words[np.cumsum(change)[:-1] == 0]
    collapsed = hashlib.sha256()
    for at in range(0, len(kept), SLICE):
        collapsed.update((b" " if at else b"") + b" ".join([vocabulary[w] for w in kept[at : at + SLICE].tolist()]))
    start, length, q = best or (None, None, None)
    return {"doc_id": doc_id, "n_runs": len(runs), "start": start, "length": length, "period": q, "exponent_milli": 1000 * length // q if q else None, "runs_sha256": lines.hexdigest(), "collapsed_sha256": collapsed.hexdigest()}


def _settle(held: list[tuple]) -> pa.RecordBatch:
    """The rows of some documents, whose words are searched as one sequence."""
    sizes = [len(words) for _, words, _ in held]
    bases = np.cumsum([0, *(len(vocabulary) for _, _, vocabulary in held)])
    at = np.cumsum([0, *sizes])
    runs = find_runs(np.concatenate([words + base for (_, words, _), base in zip(held, bases[:-1], strict=True)]))
    cut = np.searchsorted(runs[:, 0], at)
    rows = []
    for k, (doc_id, words, vocabulary) in enumerate(held):
        rows.append(_row(doc_id, words, vocabulary, runs[cut[k] : cut[k + 1]] - [at[k], 0, 0]))
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for k, doc_id in enumerate(ids):
            words, vocabulary = numbered(texts[k].as_py())
            if held and size + len(words) > BATCH_WORDS:
                yield _settle(held)
                held, size = [], 0
            held.append((doc_id, extended(words, doc_id), vocabulary))
            size += len(words) + 1
    if held:
        yield _settle(held)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: its runs counted, the one of greatest length/period (ties: smallest start, then period), and digests of all
    runs and of the text without the words that runs repeat. No shuffle: documents stay where they are read."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(_documents, RUNS)
