"""Removal of spans that a reference table holds, by broadcast suffix automata of its shards.

dedup_substrings (substring.py) compares a corpus with itself; here a reference of its own is given: a benchmark, a corpus that is already
released, boilerplate.

1. Each task reads its part of the reference, cuts long texts into pieces that overlap by a window less a word, and closes a shard as
   soon as it holds SHARD_WORDS words. A shard's suffix automaton is written as a row. No shuffle.
2. The driver streams these rows and broadcasts as many automata as fit BATCH_BYTES, a bound it measures before it broadcasts.
3. Documents stream through the automata of a batch. Where the matching statistic reaches the window, the last `window` words are part of
   a maximal span that the reference holds. Marks are kept with the document as bits.
4. A reference beyond one batch takes more rounds, each written as a table, so memory stays bounded however large it is; time grows
   with reference bytes / BATCH_BYTES times the documents.

Words are compared themselves. Defined results: a null text has no words; texts shorter than the window lose nothing; repeated rows and
null ids are rows like others; an empty reference removes nothing; empty documents give an empty table; the other columns of documents
are ignored, so their names cannot clash; ties do not arise; a very long reference text is spread over shards, a very long document stays one row.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .substring import WINDOW, SuffixAutomaton

SHARD_WORDS = 50_000
BATCH_BYTES = 128 << 20

_SHARDS = "automaton binary, n_words long"
_MARKED = "doc_id long, text string, marks binary"
_OUT = "doc_id long, n_words long, n_removed long, starts array<int>, lengths array<int>, kept_sha256 string, kept string"


def _pieces(words: list[bytes], size: int, window: int) -> Iterator[list[bytes]]:
    """Parts of so many words that hold each window of the whole once or more."""
    for start in range(0, max(len(words) - window + 1, 0), size):
        yield words[start : start + size + window - 1]


def _build(window: int, shard_words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, n = SuffixAutomaton(), 0

        def closed() -> pa.RecordBatch:
            packed = zlib.compress(pickle.dumps((automaton.next, automaton.link, automaton.length), protocol=5), 1)
            return pa.RecordBatch.from_pydict({"automaton": pa.array([packed], pa.binary()), "n_words": pa.array([n], pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                for piece in _pieces((text.as_py() or "").encode().split(), shard_words, window):
                    automaton.add(piece)
                    n += len(piece)
                    if n >= shard_words:
                        yield closed()
                        automaton, n = SuffixAutomaton(), 0
        if n:
            yield closed()

    return build


def _load(packed: bytes) -> SuffixAutomaton:
    automaton = SuffixAutomaton()
    automaton.next, automaton.link, automaton.length = pickle.loads(zlib.decompress(packed))
    return automaton


def _match(shards, window: int):
    """shards: a broadcast list of packed automata. One is unpacked at a time and meets all documents of an Arrow batch."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t.as_py() or "").encode().split() for t in batch.column("text")]
            marks = [np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(w), bitorder="little") if m.is_valid else np.zeros(len(w), np.uint8) for m, w in zip(batch.column("marks"), words, strict=True)]
            long = [k for k, w in enumerate(words) if len(w) >= window]
            for packed in shards.value if long else []:
                automaton = _load(packed)
                for k in long:
                    ends = np.fromiter((size == window for size, _ in automaton.matches(words[k], window)), bool, len(words[k]))
                    if ends.any():
                        # a word is covered by windows that end on it or up to window - 1 words after it
                        total = np.concatenate([[0], np.cumsum(ends)])
                        after = np.minimum(np.arange(len(ends)) + window, len(ends))
                        marks[k] |= (total[after] > total[:-1]).astype(np.uint8)
            packed_marks = [np.packbits(m, bitorder="little").tobytes() for m in marks]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(packed_marks, pa.binary())], ["doc_id", "text", "marks"])

    return match


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "starts", "lengths", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
    for batch in batches:
        out: list[tuple] = []
        for doc, text, marks in zip(batch.column("doc_id"), batch.column("text"), batch.column("marks"), strict=True):
            words = (text.as_py() or "").encode().split()
            covered = np.unpackbits(np.frombuffer(marks.as_py(), np.uint8), count=len(words), bitorder="little") if marks.is_valid else np.zeros(len(words), np.uint8)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8)))
            kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
            out.append((doc.as_py(), len(words), int(covered.sum()), edges[::2], edges[1::2] - edges[::2], hashlib.sha256(kept).hexdigest(), kept.decode()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def _batches(shards: DataFrame, batch_bytes: int) -> Iterator[list[bytes]]:
    """Automata in runs of at most so many bytes (one that is larger goes alone); the driver holds one run and one partition."""
    held: list[bytes] = []
    size = 0
    for row in shards.toLocalIterator():
        packed = bytes(row.automaton)
        if held and size + len(packed) > batch_bytes:
            yield held
            held, size = [], 0
        held.append(packed)
        size += len(packed)
    if held:
        yield held


def remove_reference_spans(
    docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, batch_bytes: int = BATCH_BYTES, id_column: str = "doc_id", text_column: str = "text", reference_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, starts and lengths of the removed spans (in words), kept_sha256 and kept of every row of docs."""
    spark = docs.sparkSession
    shards = stored(reference.select(F.col(reference_text).cast("string").alias("text")).mapInArrow(_build(window, shard_words), _SHARDS), "reference-shards").select("automaton")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.lit(None).cast("binary").alias("marks"))
    before = None
    for held in _batches(shards, batch_bytes):
        if before is not None:
            rows = stored(before, "reference-marks")
        before = rows.mapInArrow(_match(spark.sparkContext.broadcast(held), window), _MARKED)
    return (rows if before is None else before).mapInArrow(_remove, _OUT)
