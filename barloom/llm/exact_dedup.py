r"""Exact deduplication with an extendible-hash index on shared files.

A text is normalised (each run of white space becomes one space) and hashed to a 64-bit key. The index files entries in
buckets by the first bits of their keys. Its directory starts with one slot and one bucket; a bucket of more than
`capacity` keys splits by its next bit, and the directory doubles each time that a bucket gets deeper than it; it is kept
as the list of buckets in key order, since slots of one bucket are neighbours. Buckets are dealt
to owner tasks and written to the shared folder, a file for each owner. An owner reads its file in the order of keys and
walks the chain of each key: an entry joins the first link whose bytes are the same as its own, or adds a link. So the
owner decides what is a copy of what, which id stays, and how large the group is.

Scale. Entries are folded where the text is read: a task sends one entry for each content (with the smallest id and the
number of rows), so a text that makes up a third of all rows reaches its owner as often as there are tasks, not rows.
Only keys seen twice or more send their bytes along, as a key seen once has nothing to be compared with. Keys are counted
first (8 bytes a row, pre-aggregated); which of them recur is broadcast while that is small and else joined by shuffle.
A bucket's directory comes from a histogram of key prefixes: capacity grows with the input, so that there are at most
about 2^17 buckets, and only the prefixes of overfull buckets are counted deeper. The driver holds nothing else.

Defined cases: null text is empty; of rows with equal text the one with the smallest doc_id stays (null ids last, one
row only if ids repeat); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import SPACES, cut, small, spread, text_of

CAPACITY = 50_000
MOST_BUCKETS = 1 << 16
#: Bytes of text that a task holds while it folds copies, and that an owner sends at once.
_HELD = 32 << 20
_STEP = 4


def directory(count: Callable[[list[tuple[int, int]], int], dict[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """The buckets (prefix, local depth, keys) in key order; together they cover every key once.

    count(buckets, depth): keys for each prefix of `depth` bits below the given buckets. Splits a bucket while it holds
    more than `capacity` keys and bits are left."""
    done: list[tuple[int, int, int]] = []
    open_ = {(0, 0): sum(count([(0, 0)], 0).values())}
    while open_:
        done += [(*b, n) for b, n in open_.items() if n <= capacity or b[1] == 64]
        full = {b: n for b, n in open_.items() if n > capacity and b[1] < 64}
        if not full:
            break
        local = next(iter(full))[1]
        depth = min(64, local + max(_STEP, (max(full.values()) // capacity).bit_length()))
        cells: dict[int, dict[int, int]] = {p: {} for p, _ in full}
        for c, n in count(sorted(full), depth).items():
            cells[c >> (depth - local)][c] = n
        open_ = {}
        stack = [(p, local, held) for p, held in cells.items()]
        while stack:  # split bit by bit, as far as the cells tell
            p, d, held = stack.pop()
            n = sum(held.values())
            if n <= capacity:
                done.append((p, d, n))
            elif d < depth:
                for half in (2 * p, 2 * p + 1):
                    stack.append((half, d + 1, {c: k for c, k in held.items() if c >> (depth - d - 1) == half}))
            else:
                open_[p, d] = n
    return sorted(done, key=lambda b: b[0] << (64 - b[1]))


def _buckets(keys: DataFrame, capacity: int) -> list[tuple[int, int, int]]:
    """The directory of distinct keys; keys: (key), cut."""

    def count(of: list[tuple[int, int]], depth: int) -> dict[int, int]:
        if not depth:
            return {0: keys.count()}
        prefix: Column = F.shiftrightunsigned("key", 64 - depth)
        local = of[0][1]
        rows = keys
        if local:  # below overfull buckets only
            wanted = keys.sparkSession.createDataFrame([(_signed(p),) for p, _ in of], "bucket long")
            rows = keys.join(F.broadcast(wanted), F.shiftrightunsigned("key", 64 - local) == F.col("bucket"))
        return {r[0] & ((1 << 64) - 1): r[1] for r in rows.groupBy(prefix.alias("cell")).count().collect()}

    return directory(count, capacity)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ENTRY = "bucket int, key long, digest binary, text binary, missing boolean, rep long, n long, ties long"


def _less(a: tuple[bool, int | None], b: tuple[bool, int | None]) -> bool:
    return a[0] < b[0] or (not a[0] and not b[0] and a[1] < b[1])


class Content:
    """Rows of one text: its smallest id (`missing` if none has one), rows, and rows that have that id."""

    __slots__ = ("digest", "missing", "n", "rep", "text", "ties")

    def __init__(self, digest: bytes, text: bytes | None, missing: bool, rep: int | None, n: int, ties: int) -> None:
        self.digest, self.text, self.missing, self.rep, self.n, self.ties = digest, text, missing, rep, n, ties

    def add(self, other: Content) -> None:
        mine, yours = (self.missing, self.rep), (other.missing, other.rep)
        if _less(yours, mine):
            self.missing, self.rep, self.ties = other.missing, other.rep, other.ties
        elif not _less(mine, yours):
            self.ties += other.ties
        self.n += other.n


def _folder(starts: np.ndarray):
    """Folds the copies that a task reads; starts: first key of each bucket, unsigned."""

    def send(held: dict[tuple[int, bytes], Content]) -> pa.RecordBatch:
        keys = np.array([k for k, _ in held], np.int64)
        bucket = np.searchsorted(starts, keys.view(np.uint64), "right") - 1
        c = list(held.values())
        columns = [pa.array(bucket.astype(np.int32)), pa.array(keys), *(pa.array([getattr(x, f) for x in c], t) for f, t in (("digest", pa.binary()), ("text", pa.binary()), ("missing", pa.bool_()), ("rep", pa.int64()), ("n", pa.int64()), ("ties", pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "digest", "text", "missing", "rep", "n", "ties"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], Content] = {}
        size = 0
        for b in batches:
            for key, digest, text, doc in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "text", "doc_id")), strict=True):
                new = Content(digest, text, doc is None, doc, 1, 1)
                old = held.get((key, digest))
                if old is not None and old.text == text:
                    old.add(new)
                    continue
                if old is not None:  # another text with this key and digest: goes by itself
                    yield send({(key, digest): new})
                    continue
                held[key, digest] = new
                size += 200 + len(text or b"")
                if size > _HELD:
                    yield send(held)
                    held, size = {}, 0
        if held:
            yield send(held)

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner: its file comes in the order of keys; each key's chain is walked once, comparing bytes."""
    chain: list[Content] = []
    key = None
    out: list[tuple] = []

    def close() -> None:
        digests = [c.digest for c in chain]
        for link, c in enumerate(chain):
            out.append((key, c.digest, link, None if c.missing else c.rep, c.n, c.ties, digests.count(c.digest) > 1))

    def send() -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "digest", "link", "rep", "n", "ties", "clash"])

    for b in batches:
        for k, *entry in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "text", "missing", "rep", "n", "ties")), strict=True):
            if k != key:
                close()
                chain, key = [], k
            new = Content(*entry)
            same = next((c for c in chain if c.text == new.text), None)
            if same is None:
                chain.append(new)
            else:
                same.add(new)
        if out:
            yield send()
            out = []
    close()
    if out:
        yield send()


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", F.regexp_replace(text_of(), SPACES, " ").alias("norm"))
    keyed = texts.select("doc_id", F.xxhash64("norm").alias("key"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.col("norm").cast("binary").alias("text"))
    base = cut(keyed.select("doc_id", "key", "digest"))
    keys = cut(base.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("again")))

    buckets = _buckets(keys.select("key"), max(capacity, keys.count() // MOST_BUCKETS))
    starts = np.array([p << (64 - d) if d else 0 for p, d, _ in buckets], np.uint64)
    again = keys.where("again").select("key", "again")
    marked = keyed.join(small(again, 200_000), "key", "left").withColumn("text", F.when(F.col("again"), F.col("text")))
    entries = marked.select("doc_id", "key", "digest", "text").mapInArrow(_folder(starts), _ENTRY)
    owners = max(1, min(len(buckets), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # bucket b is owner (b * owners) / buckets's: neighbouring buckets lie in one file, which the checkpoint writes as it is
    owner = F.floor(F.col("bucket").cast("long") * owners / len(buckets)).cast("int")
    index = cut(entries.repartitionById(owners, owner).sortWithinPartitions("bucket", "key"))
    found = cut(index.mapInArrow(_own, "key long, digest binary, link int, rep long, n long, ties long, clash boolean"))
    if found.where("clash").limit(1).count():
        return _by_bytes(texts)

    joined = spread(base, found, ["key", "digest"], "n", found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    stays = F.col("doc_id").eqNullSafe(F.col("rep"))
    if found.where("ties > 1").limit(1).count():  # ids repeat: of the rows with the id that stays, one stays
        joined = cut(joined.withColumn("row", F.monotonically_increasing_id()))
        one = joined.where(stays & (F.col("ties") > 1)).groupBy("key", "digest").agg(F.min("row").alias("one"))
        joined = joined.join(one, ["key", "digest"], "left")
        stays = stays & F.coalesce(F.col("row") == F.col("one"), F.lit(True))
    return joined.select("doc_id", F.col("rep").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _by_bytes(texts: DataFrame) -> DataFrame:
    """Should two contents share key and SHA-256: groups by the text itself."""
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("rep"), "row")
    groups = rows.groupBy("norm").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "norm").select("doc_id", F.col("m.rep").alias("keep_id"), "group_size", (F.col("row") == F.col("m.row")).alias("kept"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
