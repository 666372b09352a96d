r"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes has its top bits zero, at least `SMALLEST` and at most `LARGEST`
bytes after the chunk's start and never inside a character; so an insertion moves the chunk ends near it only. Chunks
are deduplicated by digest: the first holder (smallest doc_id, then position) keeps a chunk. In the other places a run
of consecutive known chunks is cut out if it spans at least `RUN_BYTES` bytes, so phrases that happen to recur stay, and
a passage of over 50 words goes but for what its first and last chunk share with their surroundings.

Scale. A document's digests are one row of the shared folder; exploded, each distinct digest of a document is a row of
16 bytes. They pre-aggregate to (digest, first doc, count); only digests that recur meet the rows again, in a join that
adaptive skew handling can split, so a passage in a third of all documents is no single task. Texts are shuffled once
at most, by document, to be cut.

Defined cases: null text is empty and stays null; rows with one doc_id count as one holder (a passage that they share
stays in each); rows without an id are left alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, text_of

SMALLEST, LARGEST = 16, 128
BITS = 4
RUN_BYTES = 150
_SLAB = 1 << 20
_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: sum of table[byte j back] << j, modulo 2^32, by doubling the window five times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a text's UTF-8 bytes."""
    n = len(raw)
    if not n:
        return []
    data = np.frombuffer(raw, np.uint8)
    start = np.ones(n + 1, bool)
    start[:n] = (data & 0xC0) != 0x80
    marks: list[np.ndarray] = []
    for k in range(0, n, _SLAB):  # in slabs that overlap by a window
        low = max(0, k - 32)
        h = gear(data[low : k + _SLAB])[k - low :]
        marks.append(np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + k + 1)
    ends, begin = [], 0
    for m in np.concatenate(marks).tolist():
        while m - begin > LARGEST:
            e = begin + LARGEST
            while not start[e]:
                e -= 1
            ends.append(e)
            begin = e
        if m - begin >= SMALLEST and start[m]:
            ends.append(m)
            begin = m
    while n - begin > LARGEST:
        e = begin + LARGEST
        while not start[e]:
            e -= 1
        ends.append(e)
        begin = e
    if begin < n:
        ends.append(n)
    return ends


def chunks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(digest, length) of each chunk; two empty arrays for an empty text."""
    raw = text.encode("utf-8", "replace")
    ends = [0, *cuts(raw)]
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(raw[a:b]) for a, b in itertools.pairwise(ends)], np.uint64).view(np.int64), np.diff(ends).astype(np.int32)


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = pa.array([chunks(t)[0] for t in b.column("text").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), digests], ["doc_id", "th", "digests"])


def clean(text: str | None, known: np.ndarray, run_bytes: int = RUN_BYTES) -> tuple[str | None, list[list[int]], int]:
    """(text without the runs of chunks whose digests are in `known` or came before in the text, their spans in
    characters, number of chunks)."""
    if not text:
        return text, [], 0
    raw = text.encode("utf-8", "replace")
    digests, lengths = chunks(text)
    first = np.zeros(len(digests), bool)
    first[np.unique(digests, return_index=True)[1]] = True
    gone = ~first | np.isin(digests, known)
    ends = np.cumsum(lengths)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    kept, spans, at, chars = [], [], 0, 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        low, high = int(ends[a] - lengths[a]), int(ends[b - 1])
        if high - low >= run_bytes:
            kept.append(raw[at:low])
            chars += len(kept[-1].decode())
            cut_out = len(raw[low:high].decode())
            spans.append([chars, chars + cut_out])
            chars += cut_out
            at = high
    kept.append(raw[at:])
    return b"".join(kept).decode(), spans, len(digests)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [clean(t, np.array(k or [], np.int64)) for t, k in zip(b.column("text").to_pylist(), b.column("known").to_pylist(), strict=True)]
        columns = [pa.array([n for *_, n in done], pa.int64()), pa.array([sum(b - a for a, b in s) for _, s, _ in done], pa.int64()), pa.array([s for _, s, _ in done], pa.list_(pa.list_(pa.int64()))), pa.array([t for t, *_ in done], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_chunks", "n_removed", "removed", "text"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_removed: characters, removed: spans of characters, text: what is left) for every row."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), F.col("text").cast("string").alias("text"))
    digests = cut(texts.where("doc_id IS NOT NULL").withColumn("text", text_of()).mapInArrow(_chunk, "doc_id long, th long, digests array<long>"))
    rows = digests.select("doc_id", "th", F.explode(F.array_distinct("digests")).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    known = rows.join(first, "digest").where("doc_id > first").groupBy("doc_id", "th").agg(F.collect_set("digest").alias("known"))
    known = known.select(F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "known")
    joined = texts.join(known, (F.col("doc_id") == F.col("of")) & (F.col("th") == F.col("of_th")), "left").select("doc_id", "text", "known")
    return joined.mapInArrow(_clean, "doc_id long, n_chunks long, n_removed long, removed array<array<long>>, text string")
