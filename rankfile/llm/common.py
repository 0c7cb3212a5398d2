"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Used only where the session names no shared folder (tests on one machine).
LOCAL_SHARED = "/tmp/checkpoints/rankfile"
#: Rows that one numbering task should sort.
BUCKET_ROWS = 20_000
#: Tasks that write a table of known size: one for so many rows, and some at least.
FILE_ROWS, LEAST_FILES = 1 << 20, 16
#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share, as the cluster names it. A session on one machine (tests)
    may name none; a cluster must, as a folder of its machines' own would lose rows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/") if named else LOCAL_SHARED


#: Tables written within the scratch() blocks that are open, the innermost last.
_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what store() wrote within it, but for tables that are to be kept: nothing that is still to run
    may read the others."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        discard(*_SCRATCH.pop())


def store(df: DataFrame, name: str, rows: int | None = None, per: int = FILE_ROWS, keep: bool = False) -> DataFrame:
    """Writes `df` to the shared folder and reads it back.

    This cuts the lineage (a lost executor costs no earlier stage) and gives the planner true sizes. rows: about how
    many rows `df` has at most, if known; the last stage then has a task (and a file) for each `per` of them, so that
    small tables are not written as hundreds of files. The files go when the driver's file system closes, or by
    discard(), or at the end of the innermost scratch(), if `keep` does not leave them to the one around it.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // per)))
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankfile-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = target
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(out)
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes what store() wrote, once nothing that is still to run reads it."""
    for df in stored:
        target = df._stored
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def bloom_filters(spark: SparkSession) -> Iterator[None]:
    """While this holds, the planner puts a Bloom filter (of bounded size) before a join's shuffle at any size."""
    at = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {f"{at}enabled": "true", f"{at}applicationSideScanSizeThreshold": "0", f"{at}creationSideThreshold": "1g"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts holds, in bytes. Rows a batch stay as the session has them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bucket_bits(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    bits = 0
    while rows >> bits > per_bucket and bits < 24:
        bits += 1
    return bits


def numbered(df: DataFrame, keys: list[str], order: list[Column], rows: int, name: str) -> DataFrame:
    """Adds `name`: the gapless rank from 0 of each row within its keys, by (first of `order`, rest of it).

    The first order column must be a uniform 64-bit hash. A key's rows are dealt to buckets by the hash's
    leading bits and only buckets are sorted, so a key with a third of all rows is spread over many tasks;
    a bucket's first rank comes from the counts of the buckets before it.
    """
    bits = bucket_bits(rows)
    bucket = F.shiftrightunsigned(order[0].bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = df.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(sizes, same).withColumn(name, F.col("_inner") + F.col("_before")).drop("_bucket", "_b", "_before", "_inner", *[f"_k{i}" for i in range(len(keys))])


def ranked(values: DataFrame, column: str, name: str) -> DataFrame:
    """Adds `name`: the place from 0 of each row of `values`, which are distinct in `column`, null last.

    Rows are dealt out by ranges and numbered in each; only the ranges' sizes meet in one task.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.col(column).isNull()
    dealt = store(values.repartitionByRange(parts, last, column).withColumn("_part", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(last, column)) - 1
    return dealt.withColumn("_inside", inside).join(before, F.col("_part") == F.col("_p")).withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_p", "_inside", "_before")


def apart(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """`docs` with each row as one struct, `_row`, beside `columns`: no name of theirs can clash with the operator's."""
    return docs.select(F.struct("*").alias("_row"), *columns)


def row_columns(docs: DataFrame) -> list[Column]:
    """The columns of the rows that apart() set aside."""
    return [F.col("_row").getField(c).alias(c) for c in docs.columns]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
