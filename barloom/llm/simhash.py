r"""Near-duplicate links between 64-bit SimHash fingerprints, by anchor-point covering.

Fingerprint: lower-cased A-Z, words, 3-word shingles with repeats, XXH64 (seed 42) of each; a bit is 1 if it is set in
over half of them. Two fingerprints link at 3 or fewer differing bits.

Covering. Of the two 32-bit halves of linked fingerprints at least one differs in at most 1 bit. On 31 bits of a half
the perfect Hamming(31, 26) code is the covering code: its covering radius is 1, so the anchors (codewords) within
radius plus threshold, 1 + 1 = 2, of a half include the nearest anchor of every half at distance 1. That is 16 anchors
of 2^26 for each half (1 if the half is itself an anchor). Fingerprints are replicated to those, and compared in each
anchor's group; only pairs of which one is at its own nearest anchor need comparing.

Scale. Equal fingerprints are folded to one row first, so exact copies cost nothing. Groups are streamed from sorted
partitions and give the edges of a spanning forest, never all pairs. A group beyond `block` fingerprints (a dense
cluster of near copies) is dealt into blocks, and each pair of blocks is a group of its own, so no task holds it all
and no comparison is left out. Links and fingerprints stay distributed.

Pairs of one anchor are all compared, so work grows with the square of what an anchor holds: 2^26 anchors a half and up to
32 copies of a fingerprint mean 2 rows an anchor at 4 million distinct fingerprints and 500 at a billion. Beyond that,
codes on longer parts of the fingerprint are due (`most` and the parts are the operator's own to change).

Defined cases: null text is empty; texts without words have fingerprint zero; fewer than 3 words are one shingle; rows of
a repeated id are rows of their own, linked by their fingerprints only; rows without an id have a fingerprint, link like
any other, and get the smallest id they reach, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import WORD_RE_BYTES, cut, fresh, small, spread, text_of
from .components import components

MAX_BITS = 3
SHINGLE = 3
BLOCK = 4096
_SLAB = 1 << 18


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    found = WORD_RE_BYTES.findall((text or "").encode("utf-8", "replace").lower())  # bytes.lower(): A-Z only
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], ">u8")
    for k in range(0, n, _SLAB):
        counts += np.unpackbits(hashes[k : k + _SLAB].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps)], ["doc_id", "th", "fp"])


def _syndrome() -> np.ndarray:
    """For each 16-bit value: XOR of the positions (from 1) of its set bits; of a 31-bit word the parts are XORed."""
    s = np.zeros(1 << 16, np.int64)
    for bit in range(16):
        s[1 << bit : 1 << (bit + 1)] = s[: 1 << bit] ^ (bit + 1)
    return s


_LOW = _syndrome()
_HIGH = np.zeros(1 << 15, np.int64)
for _bit in range(15):
    _HIGH[1 << _bit : 1 << (_bit + 1)] = _HIGH[: 1 << _bit] ^ (_bit + 17)


def _flips() -> np.ndarray:
    """flips[s]: the 16 masks that turn a word of syndrome s != 0 into the anchors within 2 bits, the nearest first."""
    rows = np.zeros((32, 16), np.int64)
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i != s and i < i ^ s]
        rows[s] = [1 << (s - 1), *pairs]
    return rows


_FLIPS = _flips()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (row, anchor, home) of every copy; home marks the nearest anchor."""
    rows, keys, homes = [], [], []
    for half in (0, 1):
        x = ((fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        s = _LOW[x & 0xFFFF] ^ _HIGH[x >> 16]
        codeword = s == 0
        near = x[~codeword, None] ^ _FLIPS[s[~codeword]]
        rows += [np.flatnonzero(codeword), np.repeat(np.flatnonzero(~codeword), 16)]
        keys += [x[codeword] | (half << 32), near.ravel() | (half << 32)]
        homes += [np.ones(codeword.sum(), bool), np.tile(np.arange(16) == 0, len(near))]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy()
        rows, keys, homes = anchors(fps.view(np.uint64))
        for k in range(0, len(rows), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(fps[rows[part]]), pa.array(homes[part])], ["anchor", "fp", "home"])


class _Forest:
    """Union-find over what a task has linked; tells which links are new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(keys: np.ndarray, fps: np.ndarray, homes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows with equal keys (rows sorted by key)."""
    left, right = [], []
    n, step = len(fps), 1
    ends = np.searchsorted(keys, keys, side="right") if n else np.zeros(0, np.int64)
    live = np.arange(n)
    while True:
        live = live[live + step < ends[live]]
        if not len(live):
            break
        other = live + step
        ok = (np.bitwise_count(fps[live] ^ fps[other]) <= most) & (homes[live] | homes[other])
        left.append(live[ok])
        right.append(other[ok])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = _Forest(), None

        def edges(group: pa.RecordBatch) -> pa.RecordBatch | None:
            fps = group.column("fp").to_numpy()
            a, b = _links(group.column("key").to_numpy(), fps.view(np.uint64), group.column("home").to_numpy(zero_copy_only=False), most)
            new = [k for k, (x, y) in enumerate(zip(fps[a].tolist(), fps[b].tolist(), strict=True)) if forest.join(x, y)]
            return pa.RecordBatch.from_arrays([pa.array(fps[a[new]]), pa.array(fps[b[new]])], ["u", "v"]) if new else None

        for b in batches:
            now = b if held is None else pa.concat_batches([held, b])
            if not now.num_rows:
                continue
            keys = now.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1], side="left"))  # the last group may go on in the next batch
            held = now.slice(last)
            if last and (out := edges(now.slice(0, last))) is not None:
                yield out
        if held is not None and (out := edges(held)) is not None:
            yield out

    return run


def links(reps: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Forest edges (u, v) between distinct fingerprints at `most` bits or fewer; reps: (fp)."""
    copies = reps.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    crowded = cut(copies.groupBy("anchor").count().where(F.col("count") > block))
    some = crowded.limit(1).count() > 0
    if some:  # the crowded anchors' groups, dealt into pairs of blocks
        crowded = crowded.select("anchor", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
        hint = small(crowded, 20_000)
        calm = copies.join(hint, "anchor", "left_anti").withColumn("pair", F.lit(0).cast("long"))
        dealt = copies.join(hint, "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        dealt = dealt.withColumn("pair", (1 + F.least("own", "with") * F.col("blocks") + F.greatest("own", "with")).cast("long"))
        copies = calm.unionByName(dealt.select("anchor", "fp", "home", "pair"))
        copies = copies.select(F.xxhash64("anchor", "pair").alias("key"), "fp", "home")  # a rare clash of keys only joins two groups
    else:
        copies = copies.withColumnRenamed("anchor", "key")
    dealt = copies.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare(most), "u long, v long")


def _grouped(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, th: hash of the text, fp, component_id, of: the fingerprint that stands for the component) for every row."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    prints = cut(texts.mapInArrow(_fingerprints, "doc_id long, th long, fp long"))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    linked = components(links(reps, most))
    known = cut(reps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("of")))
    groups = known.groupBy("of").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("held"))
    distinct, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = cut(spread(known.select("fp", "n", "of"), cut(groups), ["of"], "held", distinct).select("fp", "n", "of", "component_id"))
    return spread(prints, named, ["fp"], "n", total)


def simhash_groups(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    return _grouped(docs, most).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group: the smallest id's (of a repeated id, the text with the smallest hash; of rows alike
    in id and text, any one)."""
    grouped = cut(_grouped(docs, most))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")).alias("m")
    (h,) = fresh(docs, "text_hash")
    id_, th = fresh(docs, "keep_id", "keep_hash")
    keep = grouped.groupBy("of").agg(first).select(F.col("m.id").alias(id_), F.col("m.th").alias(th))
    stays = docs.withColumn(h, F.xxhash64(text_of())).join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(th)), "left_semi")
    repeated = grouped.groupBy("doc_id", "th").count().where("count > 1").limit(1).count()
    if repeated:
        seen, row = fresh(docs, "row_of_id", "row_no")
        stays = cut(stays.withColumn(row, F.monotonically_increasing_id()))
        one = stays.groupBy(F.col("doc_id").alias(id_), F.col(h).alias(th)).agg(F.min(row).alias(seen))
        stays = stays.join(one, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(th)) & (F.col(row) == F.col(seen)), "left_semi").drop(row)
    return stays.drop(h)
