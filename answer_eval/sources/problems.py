"""Problem tables: scan (S1), label coercion (T16), result order (L2); numbering (W1) and the
first N (L1) are in ``numbering``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answer_eval.functions.text import py_strip
from answer_eval.sources.csv_records import read_csv
from answer_eval.sources.numbering import first_n, number_rows, number_samples, number_within  # noqa: F401

# Declared problem schema in file column order, with the file's own header names
# (the reader renames hyphens to underscores afterwards).
PROBLEM_SCHEMA = T.StructType([
    T.StructField("story_id", T.LongType()),
    T.StructField("premises", T.StringType()),
    T.StructField("premises-FOL", T.StringType()),
    T.StructField("conclusion", T.StringType()),
    T.StructField("conclusion-FOL", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("example_id", T.LongType()),
])

# pandas.read_csv's default missing-value markers (public pandas documentation).
PANDAS_NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Columns without which a problem table is of no use, and the order key of its files.
REQUIRED_COLUMNS = ("premises", "conclusion", "label")
FILE_ORDER = ("file_path", "file_row")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop FileSystem (works for local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath)) or len(fs.globStatus(jpath) or []) > 0


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder, through the Hadoop FileSystem."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath)) and bool(fs.getFileStatus(jpath).isDirectory())


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """First path of the ordered candidates that exists; else fail naming all."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"no problem table at any of these paths: {', '.join(paths)}")


# S1 -----------------------------------------------------------------------
def read_problems(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv",
                  schema: T.StructType | None = PROBLEM_SCHEMA,
                  na_values: Sequence[str] | None = None, file_order: bool = False) -> DataFrame:
    """Read the first existing candidate path as a problem table.

    CSV: header row, quoted multi-line fields (``csv_records``: a file is read by many tasks), columns by
    their header names in any order, read as text and cast to the declared type
    (never inferred: a True/False label column would become BOOLEAN).  A declared
    column that the header lacks is NULL, but ``REQUIRED_COLUMNS`` must be there;
    further columns stay, as text.  Parquet/ORC/JSON are read as stored.
    ``na_values`` turns the listed strings into NULL in string columns
    (``PANDAS_NA_VALUES`` mimics pandas).  Hyphenated column names are renamed with
    underscores, lower-cased (premises-FOL -> premises_fol).

    ``file_order`` adds the columns of ``FILE_ORDER``: the file's path and a number that
    grows with the row's place in its file,
    the order key for numbering and for the first N in the order of the file.
    """
    candidates = [paths] if isinstance(paths, str) else list(paths)
    path = first_existing(spark, candidates)
    reader = spark.read
    if fmt == "csv":
        df = read_csv(spark, path)
        if not file_order:
            df = df.drop(*FILE_ORDER)
        if schema is not None:
            lacking = [c for c in REQUIRED_COLUMNS if c in schema.names and c not in df.columns]
            if lacking:
                raise ValueError(f"the problem table has no column {', '.join(lacking)}")
            declared = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in schema.fields]
            df = df.select(*declared, *[F.col(f"`{c}`") for c in df.columns if c not in schema.names])
    else:
        if schema is not None and fmt == "json":
            reader = reader.schema(schema)
        df = reader.format(fmt).load(path)
        if file_order:
            df = _with_file_order(df)
    for name in df.columns:
        if "-" in name:
            df = df.withColumnRenamed(name, name.replace("-", "_").lower())
    if na_values:
        string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)} - {FILE_ORDER[0]}
        df = df.select(*[
            F.when(F.col(c).isin(*na_values), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
            if c in string_cols else F.col(c)
            for c in df.columns
        ])
    return df


def _with_file_order(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias(FILE_ORDER[0]),
                     F.monotonically_increasing_id().alias(FILE_ORDER[1]))


# T16 ----------------------------------------------------------------------
def coerce_labels(df: DataFrame, label_col: str = "label", out_col: str = "expected",
                  story_col: str = "story_id", order_by: Sequence | None = None) -> DataFrame:
    """``strip(str(label))`` with NULL -> ``nan``; a missing story id column is
    filled with the 0-based row index (only when the column is absent)."""
    out = df.withColumn(out_col, F.coalesce(py_strip(F.col(label_col).cast("string")), F.lit("nan")))
    if story_col not in df.columns:
        if not order_by:
            raise ValueError(f"column {story_col!r} is absent: give order_by to number rows")
        out = number_samples(out, order_by, col_name=story_col, start=0)
    return out


# L2 -----------------------------------------------------------------------
def in_sample_order(df: DataFrame, col_name: str = "sample_num") -> DataFrame:
    """Input order at the sink: sort by the carried sample number."""
    return df.orderBy(F.col(col_name).asc_nulls_last())
