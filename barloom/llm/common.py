"""Shared pieces of the corpus operators: word rules, fold rule, lineage cuts."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: White space that parts words: space and \x09 to \x0D, nothing else.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
WORD_RE_BYTES = re.compile(WORD.encode())


def _marks() -> str:
    """Character class of the combining marks (vowel signs, accents), which Python's \\w leaves out, and the two joiners."""
    spans: list[list[int]] = []
    for c in range(0x300, 0xE01F0):
        if unicodedata.category(chr(c))[0] == "M" or c in (0x200C, 0x200D):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


_MARKS = _marks()
#: A word of letters, with the marks that belong to them.
LETTERS_RE = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")

#: Rows of a table that may be broadcast; callers count first and join by shuffle beyond it.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def text_of(name: str = "text") -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a non-null text."""
    core = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACES))


def n_words(text: Column) -> Column:
    """Number of words of a non-null text."""
    core = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, SPACES))).cast("long")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out from every fit. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lost executors cost no recomputation, and later
    steps read it as often as they like. Partitions and their order stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to `path` in the shared folder as Parquet, and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a step wrote."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores appended until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; columns with maps, which have no order, go in as JSON."""
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    plain = [F.to_json(F.struct(F.col(quoted(f.name)))) if "map<" in f.dataType.simpleString() else F.col(quoted(f.name)) for f in df.schema]
    return F.xxhash64(*plain)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is known to be small: its rows (df is cut, so counting reads it once) are at
    most `rows`, and the sum of `size`, the bytes of a row's arrays or strings where it has any, at most `most`.
    Otherwise df as it is, to be joined by shuffle."""
    if df.limit(rows + 1).count() > rows:
        return df
    if size is not None and (df.agg(F.sum(size.cast("long"))).first()[0] or 0) > most:
        return df
    return F.broadcast(df)


def spread(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with table, in which keys are unique and `n` says how many of the `total` rows have them.

    A key with a ten-thousandth of all rows or more (64 at least) meets its rows in a broadcast join, where they lie:
    there are at most 10,000 of those, whatever the input. The others are joined by shuffle, where none is hot."""
    bound = max(64, total // 10_000)
    others = [c for c in table.columns if c not in keys]
    hot = F.broadcast(table.where(F.col(n) >= bound).select(*(F.col(k).alias(f"hot_{k}") for k in keys), F.struct(*others).alias("hot")))
    marked = rows.join(hot, reduce(lambda a, b: a & b, (F.col(k) == F.col(f"hot_{k}") for k in keys)), "left")
    calm = marked.where("hot IS NULL").select(*rows.columns).join(table.where(F.col(n) < bound), keys)
    return marked.where("hot IS NOT NULL").select(*rows.columns, "hot.*").unionByName(calm.select(*rows.columns, *others))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
