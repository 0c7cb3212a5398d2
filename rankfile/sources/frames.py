"""Movetext as (input_ordinal, movetext) rows."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..stored import stored

SCHEMA = "input_ordinal long, movetext string"
#: Bits of an ordinal for the place in a file; those above are for the file.
FILE_BITS = 40


def _unsupported(kind: object) -> ValueError:
    return ValueError(f"Unsupported array type in ChunkedArray: {kind}")


def from_strings(spark: SparkSession, texts: Iterable[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def from_arrow(spark: SparkSession, column: pa.ChunkedArray | pa.Array) -> DataFrame:
    """A string or large_string column in memory; other types are refused."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        raise _unsupported(column.type)
    chunks = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    table = pa.table({"input_ordinal": pa.array(range(len(chunks)), pa.int64()), "movetext": chunks.cast(pa.string())})
    return spark.createDataFrame(table) if len(chunks) else spark.createDataFrame([], SCHEMA)


def _is_file_scan(df: DataFrame) -> bool:
    """Whether each row of `df` is one row of a Parquet file: a scan below filters and projections only."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().head()
    return node.nodeName().startswith(("LogicalRelation", "Relation")) and "parquet" in node.toString().lower()


def file_ranks(rows: DataFrame, path: str, files: list[str]) -> DataFrame:
    """Adds _file, the place of each row's file among `files` by name. One row a file is broadcast: as many as the
    driver lists to read them. A scheme's slashes are written in several ways and do not count."""
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")
    ranks = rows.sparkSession.createDataFrame(list(enumerate(sorted(files))) or [(0, "")], "_rank long, _name string")
    joined = rows.join(F.broadcast(ranks.select("_rank", plain("_name").alias("_name"))), plain(path) == F.col("_name"), "left")
    lost = F.raise_error(F.concat(F.lit("not among the files listed: "), F.col(path))).cast("long")
    return joined.withColumn("_file", F.coalesce("_rank", lost)).drop("_rank", "_name")


def _file_ordinals(df: DataFrame, column: str) -> DataFrame:
    """Ordinals by file name and place in the file: the same in every reading, whatever the tasks are."""
    rows = df.select(F.col(column).alias("movetext"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    files = df.inputFiles()
    if len(files) < 2:
        return rows.select(F.col("_row").alias("input_ordinal"), "movetext")
    return file_ranks(rows, "_path", files).select((F.shiftleft("_file", FILE_BITS) + F.col("_row")).alias("input_ordinal"), "movetext")


def from_table(df: DataFrame, column: str = "movetext") -> DataFrame:
    """Numbers a table's non-null rows and checks the column's type. Ordinals rise, with gaps.

    Rows of Parquet files are numbered by file name and place in the file. What is no such scan (a shuffle's result,
    say) has no order of its own: it is numbered as it comes and written once, so that its ordinals stay. Nulls hold no
    game and go before the numbering, so that the scan can skip them.
    """
    if column not in df.columns:
        raise _unsupported(f"no column {column}")
    if not isinstance(df.schema[column].dataType, StringType):
        raise _unsupported(df.schema[column].dataType.simpleString())
    df = df.where(F.col(column).isNotNull())
    if _is_file_scan(df):
        return _file_ordinals(df, column)
    return stored(df.select(F.monotonically_increasing_id().alias("input_ordinal"), F.col(column).alias("movetext")), "texts")


def from_parquet(spark: SparkSession, *paths: str, column: str = "movetext") -> DataFrame:
    """Only the one column is read; row groups become tasks by spark.sql.files.maxPartitionBytes."""
    return from_table(spark.read.parquet(*paths), column)
