"""Exact substring deduplication with suffix automata of reference shards.

A word goes if some window of WINDOW consecutive words that covers it occurs anywhere else, in the same document or
another. The corpus is its own reference, so automata sent whole to every task would have no size bound
and make the work quadratic. Reference shards are cut by content instead, and each document's windows
stream only through the shards that can hold their partners:

1. Documents are dealt into blocks by id. Each window belongs to the least of its GRAM-word hashes,
   its anchor; equal windows have equal anchors. Per block, distinct anchors are counted.
2. Anchors that occur once in all cannot have repeated windows. The others go back to their blocks.
3. Runs of windows with one repeated anchor become segments, equal ones of a block merged. A segment goes to the
   shard of its anchor. An anchor with over HOT segments would outgrow a shard: its windows go
   one by one, each to the shard of its own hash, so however common a passage is, its windows spread
   and equal ones meet.
4. A shard builds a suffix automaton of its segments' words and streams them through it. The state
   reached by the WINDOW last words counts the windows equal to them; two or more make a repeat.
5. The marks go back to the blocks, where covered words are removed.

Words are compared themselves; hashes only choose anchors and shards. Texts are shuffled once (Spark reuses
the exchange for steps 1, 3 and 5).

Defined results: a null text has no words; texts shorter than WINDOW lose nothing; repeated rows repeat each other's
windows, so both lose them; null ids form documents like others; an empty table gives an empty table;
other columns are ignored; ties do not arise, for a word goes or stays by its windows alone; a very long text is cut into
segments that overlap by a window, so no task holds it with others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import block_of, shuffle_partitions

WINDOW = 35
GRAM = 8
HOT = 2000
BLOCKS_PER_PARTITION = 8
SHARDS_PER_PARTITION = 8
WORD_MEMO = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _grams(words: list[bytes], size: int) -> np.ndarray:
    """Hash of each run of so many words."""
    if len(_hashes) > WORD_MEMO:
        _hashes.clear()
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = (h + w[k : k + len(h)]) * _M
    h ^= h >> np.uint64(29)
    return h * _MIX


def _window_minima(h: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` neighbours, by doubling."""
    span = 1
    while 2 * span <= size:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = size - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window; none for fewer words than a window."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return _window_minima(_grams(words, gram), window - gram + 1)


def _documents(block: pa.Table) -> list[tuple]:
    """(id, words) of a block's rows in an order that does not depend on how they came."""
    rows = zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    return [(i, (t or "").encode().split()) for i, t in rows]


def _count_anchors(window: int, gram: int):
    def count(block: pa.Table) -> pa.Table:
        number = block.column("block")[0].as_py()
        found = []
        for _, words in _documents(block):
            if len(words) < window:
                continue
            h = _grams(words, gram)
            a = _window_minima(h, window - gram + 1)
            a = np.unique(a[np.concatenate([[True], a[1:] != a[:-1]])])
            # equal windows have their anchor at two places, be it in one text: places are counted, won or not
            h = np.sort(h)
            found.append((a, np.searchsorted(h, a, "right") - np.searchsorted(h, a, "left")))
        if found:
            a, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x for _, x in found])).astype(np.int64)
        else:
            a, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return pa.table({"anchor": pa.array(a.view(np.int64)), "block": pa.array(np.full(len(a), number, np.int32)), "n": pa.array(n, pa.int64())})

    return count


SEGMENTS = "shard_key long, block int, segment binary, n int, rows array<int>, starts array<int>"


def _segments(window: int, gram: int):
    def cut(block: pa.Table, hits: pa.Table) -> pa.Table:
        at: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        number = 0
        if block.num_rows and hits.num_rows:
            number = block.column("block")[0].as_py()
            known = hits.column("anchor").to_numpy().view(np.uint64)
            order = np.argsort(known)
            known, hot = known[order], hits.column("hot").to_numpy(zero_copy_only=False)[order]
            for row, (_, words) in enumerate(_documents(block)):
                a = anchors(words, window, gram)
                if not len(a):
                    continue
                place = np.minimum(np.searchsorted(known, a), len(known) - 1)
                hit = known[place] == a
                if not hit.any():
                    continue
                single = hot[place] & hit
                own = a.copy()
                if single.any():
                    own[single] = xxh_windows(words, np.flatnonzero(single), window)
                starts = np.flatnonzero(hit & np.concatenate([[True], (own[1:] != own[:-1]) | ~hit[:-1] | single[1:] | single[:-1]]))
                ends = np.append(starts[1:], len(a))
                gaps = np.flatnonzero(~hit)
                if len(gaps):
                    k = np.searchsorted(gaps, starts)
                    ends = np.minimum(ends, np.where(k < len(gaps), gaps[np.minimum(k, len(gaps) - 1)], len(a)))
                keys = own[starts].view(np.int64).tolist()
                for key, s, e in zip(keys, starts.tolist(), ends.tolist(), strict=True):
                    at.setdefault((key, b" ".join(words[s : e + window - 1])), []).append((row, s))
        return pa.table(
            {
                "shard_key": pa.array([k for k, _ in at], pa.int64()),
                "block": pa.array([number] * len(at), pa.int32()),
                "segment": pa.array([s for _, s in at], pa.binary()),
                "n": pa.array([len(x) for x in at.values()], pa.int32()),
                "rows": pa.array([[r for r, _ in x] for x in at.values()], pa.list_(pa.int32())),
                "starts": pa.array([[s for _, s in x] for x in at.values()], pa.list_(pa.int32())),
            }
        )

    return cut


def xxh_windows(words: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[k : k + window])) for k in at.tolist()), np.uint64, len(at))


class SuffixAutomaton:
    """Of several sequences of symbols; states are numbered, state 0 is the empty sequence."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, symbols: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            to = nxt[last].get(c)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            if to is None:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p == -1:
                    last = new
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                    continue
            else:
                new, p, q = None, last, to
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if new is not None:
                link[new] = clone
            last = clone if new is None else new

    def matches(self, symbols: list, at_most: int) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each symbol, the length of the longest suffix (at_most so long) that the automaton holds, and its state."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(c, 0)
            size = size + 1 if state else 0
            if size > at_most:
                size = at_most
            while state and length[link[state]] >= size:
                state = link[state]
            yield size, state


def repeated_windows(segments: list[list], counts: list[int], window: int) -> list[np.ndarray]:
    """For each of some distinct segments, which of its windows occur twice or more in all, each segment counted so often."""
    automaton = SuffixAutomaton()
    for s in segments:
        automaton.add(s)
    seen: dict[int, int] = {}
    states = []
    for s, n in zip(segments, counts, strict=True):
        own = [state for size, state in automaton.matches(s, window) if size == window]
        for state in own:
            seen[state] = seen.get(state, 0) + n
        states.append(own)
    return [np.array([seen[x] > 1 for x in own], bool) for own in states]


MARKS = "block int, rows array<int>, starts array<int>, marks binary"


def _mark(window: int):
    def mark(shard: pa.Table) -> pa.Table:
        texts = shard.column("segment").to_pylist()
        own: dict[bytes, int] = {}
        index = [own.setdefault(t, len(own)) for t in texts]
        counts = np.bincount(index, weights=np.array(shard.column("n").to_pylist()), minlength=len(own)).astype(np.int64)
        # a shard whose segments all occur once, each with windows of its own, is told apart by the automaton as well
        numbers: dict[bytes, int] = {}
        segments = [[numbers.setdefault(w, len(numbers)) for w in t.split(b" ")] for t in own]
        found = repeated_windows(segments, counts.tolist(), window)
        keep = [k for k, i in enumerate(index) if found[i].any()]
        packed = [np.packbits(f, bitorder="little").tobytes() for f in found]
        return pa.table({"block": shard.column("block").take(pa.array(keep, pa.int64())), "rows": shard.column("rows").take(pa.array(keep, pa.int64())), "starts": shard.column("starts").take(pa.array(keep, pa.int64())), "marks": pa.array([packed[index[k]] for k in keep], pa.binary())})

    return mark


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(window: int, with_text: bool):
    def remove(block: pa.Table, marks: pa.Table) -> pa.Table:
        by_row: dict[int, list[tuple[int, bytes]]] = {}
        if marks.num_rows:
            for rows, starts, bits in zip(*(marks.column(c).to_pylist() for c in ("rows", "starts", "marks")), strict=True):
                for r, s in zip(rows, starts, strict=True):
                    by_row.setdefault(r, []).append((s, bits))
        out: list[tuple] = []
        for row, (doc, words) in enumerate(_documents(block) if block.num_rows else []):
            n = len(words)
            if row in by_row:
                repeated = np.zeros(n, np.int64)
                for s, bits in by_row[row]:
                    at = s + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                    repeated[at] = 1
                total = np.concatenate([[0], np.cumsum(repeated)])
                # a word is covered by windows that start on it or up to window - 1 words before it
                covered = total[1:] - total[np.maximum(np.arange(n) - window + 1, 0)] > 0
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            kept = b" ".join(words)
            out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))})

    return remove


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, blocks: int | None = None, with_text: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with_text) kept of every row. blocks: so many that one's texts fit in a worker's memory."""
    n = shuffle_partitions(docs.sparkSession)
    blocks = blocks or BLOCKS_PER_PARTITION * n
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    # the text tells rows of one id apart, so that an id with very many rows does not fill a block
    rows = rows.withColumn("block", block_of(F.struct("doc_id", F.substring("text", 1, 200), F.length("text")), blocks)).repartition(n, "block")
    counted = rows.groupBy("block").applyInArrow(_count_anchors(window, gram), "anchor long, block int, n long")
    # at most one row a block for each anchor, however often it occurs
    total = F.sum("n").over(Window.partitionBy("anchor"))
    hits = counted.withColumn("total", total).filter(F.col("total") > 1).select("anchor", "block", (F.col("total") > hot).alias("hot"))
    segments = rows.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(_segments(window, gram), SEGMENTS)
    shards = segments.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(SHARDS_PER_PARTITION * n)))
    marks = shards.groupBy("shard").applyInArrow(_mark(window), MARKS)
    return rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_remove(window, with_text), REMOVED)
