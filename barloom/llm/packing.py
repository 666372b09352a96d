r"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document is its token ids and an end id; only one longer than a sequence is cut, into full pieces with the remainder
first. Pieces shorter than a sequence are dealt into shards of about `SHARD`. For each shard `ISLANDS` populations evolve
apart: a child takes well-filled sequences of one parent whole, the other parent's sequences that hold any of their
pieces are dissolved, and the displaced pieces go, longest first, where they fit best. Then each island's elite migrates
to the next island, and they evolve again; a shard keeps its best packing. A first packing is best-fit decreasing, so
evolution can only gain; it stops once the lower bound on sequences is met.

Scale. Tokenising is one pass over the text in Arrow batches; from then on only (row, length) moves. A shard is a fixed
number of pieces whatever the input, dealt by hash, so no key is hot; the last sequences of the shards, which may stay
part empty, are less than one in a thousand. Seeds depend on the shard and island, and pieces are sorted, so reruns agree
for the same rows.

Defined cases: null text is empty and packs as the end id alone; repeated ids are packed each by itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, text_of

LENGTH = 2048
END = 0
SHARD = 4096
ISLANDS = 2
POPULATION = 4
GENERATIONS = 5
WELL_FILLED = 0.98
_SPECIAL = "<|endoftext|>"


def vocabulary() -> str:
    """Path of the tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def encoder(path: str):
    """text -> ids as little-endian unsigned 32-bit bytes, as the tokenizer file at `path` gives them.

    The vocabulary's rank file beside it, if there is one, is read by the faster library; both give the same ids."""
    from pathlib import Path

    ranks = Path(path).with_suffix(".tiktoken")
    if ranks.exists():
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
        special = {_SPECIAL: 50256}
        known = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

        def encode(text: str) -> bytes:
            if _SPECIAL in text:
                return np.array(known.encode(text, allowed_special="all"), "<u4").tobytes()
            return known.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

        return encode
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces_of(ids: bytes, most: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids and the end id."""
    ids += np.array([END], "<u4").tobytes()
    n = len(ids) // 4
    first = n if n <= most else (n % most or most)
    at = [0, *range(first, n, most)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, [*at[1:], n], strict=True))]


def _tokenise(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                out += [(doc, *p) for p in pieces_of(encode(text), most)]
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Bins:
    """Open sequences by free room, for best fit in constant time."""

    def __init__(self, room: np.ndarray) -> None:
        self.room = room.tolist()
        self.by: dict[int, list[int]] = {}
        self.mask = 0
        for b, r in enumerate(self.room):
            if r > 0:
                self._put(b, r)

    def _put(self, b: int, r: int) -> None:
        self.by.setdefault(r, []).append(b)
        self.mask |= 1 << r

    def fit(self, size: int, most: int) -> int:
        """The bin with the least room that holds size; a new one if there is none."""
        fits = self.mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            held = self.by[r]
            b = held.pop()
            if not held:
                self.mask &= ~(1 << r)
        else:
            r, b = most, len(self.room)
            self.room.append(most)
        self.room[b] = r - size
        if r > size:
            self._put(b, r - size)
        return b


def _decreasing(sizes: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    bins, out = Bins(np.zeros(0, np.int64)), np.empty(len(sizes), np.int32)
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        out[i] = bins.fit(s, most)
    return out


def _compact(plan: np.ndarray) -> np.ndarray:
    return np.unique(plan, return_inverse=True)[1].astype(np.int32)


def _place(sizes: np.ndarray, plan: np.ndarray, loose: np.ndarray, most: int) -> np.ndarray:
    """plan with the loose pieces put where they fit best, longest first."""
    fixed = ~loose
    out = np.full(len(plan), -1, np.int32)
    out[fixed] = _compact(plan[fixed])
    fill = np.bincount(out[fixed], sizes[fixed], int(out.max()) + 1 if fixed.any() else 0).astype(np.int64)
    bins = Bins(most - fill)
    moved = np.flatnonzero(loose)
    moved = moved[np.argsort(-sizes[moved], kind="stable")]
    for i, s in zip(moved.tolist(), sizes[moved].tolist(), strict=True):
        out[i] = bins.fit(s, most)
    return out


def _worth(sizes: np.ndarray, plan: np.ndarray, most: int) -> tuple[int, float]:
    """(sequences, minus the sum of squared fills): smaller is better."""
    fill = np.bincount(plan, sizes) / most
    return len(fill), -float((fill * fill).sum())


def crossover(sizes: np.ndarray, to: np.ndarray, of: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """A child of `to` that holds about half of the well-filled sequences of `of` whole."""
    fill = np.bincount(of, sizes)
    chosen = (fill >= WELL_FILLED * most) & (rng.random(len(fill)) < 0.5)
    given = chosen[of]
    dissolved = np.zeros(int(to.max()) + 1, bool)
    dissolved[to[given]] = True
    child = np.where(given, of.astype(np.int64) + len(dissolved), to)
    return _place(sizes, child, ~given & dissolved[to], most)


def mutate(sizes: np.ndarray, plan: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """Dissolve the emptiest tenth of the sequences and a few others."""
    fill = np.bincount(plan, sizes)
    gone = rng.random(len(fill)) < 0.03
    gone[np.argsort(fill, kind="stable")[: max(1, len(fill) // 10)]] = True
    return _place(sizes, plan, gone[plan], most)


def evolve(sizes: np.ndarray, plans: list[np.ndarray], seed: int, most: int = LENGTH, generations: int = GENERATIONS, population: int = POPULATION) -> list[np.ndarray]:
    """Plans, best first; starts from best-fit decreasing and noisy versions of it if none are given."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // most)
    if not plans:
        plans = [_decreasing(sizes, np.argsort(-sizes, kind="stable"), most)]
        while len(plans) < population and _worth(sizes, plans[0], most)[0] > bound:
            plans.append(_decreasing(sizes, np.argsort(-sizes * rng.uniform(0.8, 1.0, len(sizes)), kind="stable"), most))
    pool = sorted(((_worth(sizes, p, most), k, p) for k, p in enumerate(plans)), key=lambda x: x[:2])
    count = len(pool)
    for _ in range(generations):
        if pool[0][0][0] <= bound:
            break
        young = []
        for _ in range(population):
            a, b = rng.integers(len(pool)), rng.integers(len(pool))
            child = crossover(sizes, pool[min(a, b)][2], pool[b if a != b else (b + 1) % len(pool)][2], rng, most)
            child = mutate(sizes, child, rng, most)
            count += 1
            young.append((_worth(sizes, child, most), count, child))
        pool = sorted([*pool, *young], key=lambda x: x[:2])[:population]
    return [p for *_, p in pool]


_STATE = "shard long, island int, place int, sequences int, plan binary"


def _states(shard: int, island: int, sizes: np.ndarray, plans: list[np.ndarray]) -> pd.DataFrame:
    rows = [(shard, island, k, int(p.max()) + 1, _compact(p).astype("<i4").tobytes()) for k, p in enumerate(plans)]
    return pd.DataFrame(rows, columns=["shard", "island", "place", "sequences", "plan"])


def _begin(most: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(["length", "row"], ascending=[False, True])["length"].to_numpy(np.int64)
        shard, island = map(int, key)
        return _states(shard, island, sizes, evolve(sizes, [], 1000 * island + shard, most))

    return run


def _go_on(most: int):
    def run(key: tuple, pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(["length", "row"], ascending=[False, True])["length"].to_numpy(np.int64)
        shard, island = map(int, key)
        plans = [np.frombuffer(p, "<i4").astype(np.int32) for p in states.sort_values(["sequences", "place", "migrant"])["plan"]]
        return _states(shard, island, sizes, evolve(sizes, plans, 7_000_000 + 1000 * island + shard, most)[:1])

    return run


def _finish(key: tuple, pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
    best = states.sort_values(["sequences", "island"]).iloc[0]
    pdf["bin"] = np.frombuffer(best["plan"], "<i4")
    pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
    pdf["sequence_id"] = -1 - ((int(key[0]) << 32) | pdf["bin"].astype("int64"))
    return pdf[["row", "sequence_id", "offset"]]


def pack(docs: DataFrame, most: int = LENGTH, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", text_of().alias("text"))
    pieces = texts.mapInArrow(_tokenise(path or vocabulary(), most), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    loose = pieces.where(F.col("length") < most)
    shards = max(1, round(loose.count() / SHARD))
    items = loose.select("row", "length", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)).alias("shard"))
    islands = items.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
    states = cut(islands.groupBy("shard", "island").applyInPandas(_begin(most), _STATE))
    stay = states.withColumn("migrant", F.lit(0))
    moved = states.where("place = 0").withColumn("island", (F.col("island") + 1) % ISLANDS).withColumn("migrant", F.lit(1))
    states = cut(islands.groupBy("shard", "island").cogroup(stay.unionByName(moved).groupBy("shard", "island")).applyInPandas(_go_on(most), _STATE))
    placed = items.groupBy("shard").cogroup(states.groupBy("shard")).applyInPandas(_finish, "row long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == most).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed.unionByName(full), "row").drop("row")
