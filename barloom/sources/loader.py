"""Loading folders of per-symbol files, and aligning their rows on one grid."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Files of a folder, by name; any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"no such folder: {folder}")
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(path))


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = [next((k for k, t in enumerate(_WIDER) if isinstance(x, t)), None) for x in (a, b)]
    if None not in kinds:
        widest = _WIDER[max(kinds)]
        return T.DoubleType() if widest is T.FloatType and max(min(kinds), 0) >= 2 else widest()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return T.TimestampNTZType() if T.TimestampType not in {type(a), type(b)} else T.TimestampType()
    return T.StringType()


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Union by name: missing columns are null, types are widened to one that holds both."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds[f.name] = _wider(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    wide = [df.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns)) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)


def align(df: DataFrame, date_col: str = "date", symbol_col: str = "symbol", fill_null_strategy: str = "forward", default_fill_value: float = 0.0) -> DataFrame:
    """Every date for every symbol, in order, with gaps filled per symbol: forward, backward, zero; what is left null
    (or any other strategy) gets the default in numeric columns.

    The grid has dates x symbols rows by definition; the cross join broadcasts the smaller list of keys only if the
    planner finds it small."""
    dates, symbols = df.select(date_col).distinct(), df.select(symbol_col).distinct()
    keys = [date_col, symbol_col]
    out = dates.crossJoin(symbols).join(df, keys, "left")
    values = [c for c in out.columns if c not in keys]
    w = Window.partitionBy(symbol_col).orderBy(date_col)
    if fill_null_strategy == "forward":
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in values})
    elif fill_null_strategy == "backward":
        out = out.withColumns({c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for c in values})
    elif fill_null_strategy == "zero":
        out = out.fillna(0.0, subset=values)
    return out.fillna(default_fill_value, subset=values).select(*keys, *values).orderBy(*keys)


def _entry(folder: str) -> Column:
    """Name of the file (or of the folder of parts) directly in `folder` that a row comes from."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # paths are escaped as in a URI
    return F.regexp_extract(path, "/" + re.escape(PurePosixPath(folder.rstrip("/")).name) + "/([^/]+)(?:/[^/]*)*$", 1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _csv(spark: SparkSession, folder: str, paths: list[str], symbol_col: str) -> list[DataFrame]:
    """One frame for each header that occurs. The headers come from one pass over the first block of each file."""
    text = spark.read.text(paths).where("_metadata.file_block_start = 0")
    lines = text.select(_entry(folder).alias("name"), "value", F.monotonically_increasing_id().alias("line"))
    first = lines.groupBy("name").agg(F.min_by("value", "line").alias("header"))
    heads = {r["name"]: r["header"] for r in first.collect()}  # one line a file, as many as the listing holds
    groups: dict[str, list[str]] = {}
    for path in paths:
        head = heads.get(PurePosixPath(path).name)
        if head is not None:
            groups.setdefault(head.rstrip("\r"), []).append(path)
    frames = []
    for same in groups.values():
        df = spark.read.csv(same, header=True, inferSchema=True)
        frames.append(df if symbol_col in df.columns else df.withColumn(symbol_col, _stem(_entry(folder))))
    return frames


def _parquet(spark: SparkSession, folder: str, paths: list[str], symbol_col: str) -> list[DataFrame]:
    """One frame with all columns if the types agree; else one for each file."""
    try:
        df = spark.read.option("mergeSchema", True).parquet(*paths)
    except Exception as e:
        if len(paths) == 1 or "CANNOT_MERGE" not in str(e):
            raise
        return [f for path in paths for f in _parquet(spark, folder, [path], symbol_col)]
    if symbol_col not in df.columns:
        return [df.withColumn(symbol_col, _stem(_entry(folder)))]
    if len(paths) == 1:
        return [df]
    # a file without the column is one whose symbols are all null; it is named, nulls of other files stay
    named = df.groupBy(_entry(folder).alias("name")).agg(F.count(symbol_col).alias("n")).where("n = 0")
    without = [r["name"] for r in named.collect()]
    if not without:
        return [df]
    symbol = F.col(symbol_col)
    return [df.withColumn(symbol_col, F.when(_entry(folder).isin(without), _stem(_entry(folder))).otherwise(symbol.cast("string")))]


def prepare_sequential_data(spark: SparkSession, folder_path: str, date_col: str = "date", symbol_col: str = "symbol", fill_null_strategy: str = "forward", default_fill_value: float = 0.0) -> DataFrame:
    """Read the CSV and Parquet files of a folder (not below it), name the symbol after the file where a file has none,
    and align() the union. Other files are skipped.

    Files are read together: Parquet in one frame, CSV in one for each header, so that the plan does not grow with the
    number of files."""
    kinds: dict[str, list[str]] = {}
    for path in _files(spark, folder_path):
        kind = PurePosixPath(path).suffix.lower()
        kinds.setdefault("parquet" if kind == ".pqt" else kind.lstrip("."), []).append(path)
    frames = _csv(spark, folder_path, kinds["csv"], symbol_col) if "csv" in kinds else []
    frames += _parquet(spark, folder_path, kinds["parquet"], symbol_col) if "parquet" in kinds else []
    if not frames:
        raise ValueError(f"no CSV or Parquet file in {folder_path}")
    return align(union_relaxed(frames), date_col, symbol_col, fill_null_strategy, default_fill_value)


_KINDS = ("parquet", "csv", "json", "feather", "ipc", "xlsx", "xls")


def load(spark: SparkSession, folder: str, file_type: list[str] | None = None, prefix: str | None = None, suffix: str | None = None, has_header: bool = True) -> DataFrame:
    """Files of one symbol each (the file's stem), full-joined on date as `{symbol}_{column}`.

    Nothing is joined: the files are stacked and grouped by date once. A date that a file has twice is an error, raised
    when the result is computed. The result is wide by its definition, with columns for each file: for thousands of
    files use prepare_sequential_data, which keeps the long form. Excel files need a reader that is not a dependency of
    this package: asking for them raises ImportError if pandas cannot read them."""
    wanted = [k.lower() for k in file_type or _KINDS]
    stacked, order = [], []
    for path in _files(spark, folder):
        name = PurePosixPath(path)
        kind, stem = name.suffix.lower().lstrip("."), name.stem
        if kind not in wanted or kind not in _KINDS or (prefix and not stem.startswith(prefix)) or (suffix and not stem.endswith(suffix)):
            continue
        if kind == "parquet":
            df = spark.read.parquet(path)
        elif kind == "csv":
            df = spark.read.csv(path, header=has_header, inferSchema=True)
        elif kind == "json":
            df = spark.read.option("multiLine", True).json(path)
        else:
            df = _binary(spark, path, kind)
        if "date" not in df.columns:
            raise ValueError(f"{path} has no column date")
        order += [f"{stem}_{c}" for c in df.columns if c != "date"]
        stacked.append(df.select("date", F.lit(len(stacked)).alias("file no"), *(F.col(f"`{c}`").alias(f"{stem}_{c}") for c in df.columns if c != "date")))
    if not stacked:
        raise ValueError(f"no file to load in {folder}")
    rows = union_relaxed(stacked)
    once = F.count("file no") == F.size(F.collect_set("file no"))
    kind = rows.schema["date"].dataType
    wide = rows.groupBy("date").agg(once.alias("once"), *(F.max(F.col(f"`{c}`")).alias(c) for c in order))  # of one row a file
    twice = F.raise_error(F.concat(F.lit("a file has this date twice: "), F.coalesce(F.col("date").cast("string"), F.lit("null")))).cast(kind)
    return wide.select(F.when(F.col("once"), F.col("date")).otherwise(twice).alias("date"), *(F.col(f"`{c}`") for c in order)).orderBy("date")


def _binary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Feather, Arrow IPC and Excel files, parsed by the task that reads them through Spark's binary source."""
    import io

    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    def table(raw: bytes) -> pa.Table:
        return pa.ipc.open_file(io.BytesIO(raw)).read_all() if kind in ("feather", "ipc") else pa.Table.from_pandas(pd.read_excel(io.BytesIO(raw)), preserve_index=False)

    def schema(batches):
        for b in batches:
            for raw in b.column("content").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([table(raw).schema.remove_metadata().serialize().to_pybytes()])], ["schema"])

    def rows(batches):
        for b in batches:
            for raw in b.column("content").to_pylist():
                yield from table(raw).replace_schema_metadata(None).to_batches()

    content = spark.read.format("binaryFile").load(path).select("content")
    known = pa.ipc.read_schema(pa.py_buffer(content.mapInArrow(schema, "schema binary").first()[0]))
    return content.mapInArrow(rows, from_arrow_schema(known))


def to_long(wide: DataFrame, columns: list[str], date_col: str = "date") -> DataFrame:
    """(date, symbol, one column each) from `{symbol}_{column}`."""
    symbols = [c[: -len(columns[0]) - 1] for c in wide.columns if c.endswith(f"_{columns[0]}")]
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), *((F.col(f"`{s}_{c}`") if f"{s}_{c}" in wide.columns else F.lit(None)).cast("double").alias(c) for c in columns)) for s in symbols)))
    return wide.select(date_col, rows.alias("r")).select(date_col, "r.*")
