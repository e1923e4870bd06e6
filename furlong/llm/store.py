"""Shared scratch tables and small Spark helpers for the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from furlong.llm.arrays import slices

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset and all runs on one machine, as in tests, it is a temporary one.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="furlong-")
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there.

    For columns of hashes dictionaries are made in vain, and may be left out.
    Spark may delete the shuffle files of the writing job once it has ended.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame | str) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_stored_at", None)
        if path:
            spark = SparkSession.active()
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


FAN = 4096
"""Rows of a list of files that are one group; a longer list has levels of groups, so that none is passed whole through a task or the driver."""


def running_before(files: DataFrame, number: str, value: str, name: str) -> DataFrame:
    """files with a column: the sum of a value over all rows of lower number.  Numbers are distinct, not null, from 0."""
    last = files.agg(F.max(number)).first()[0] or 0

    def level(rows: DataFrame, last: int) -> DataFrame:
        group = F.floor(F.col(number) / FAN)
        inside = Window.partitionBy("__group").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__group", group)
        own = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        if last < FAN:
            return own.drop("__group")
        sums = level(rows.groupBy("__group").agg(F.sum(value).alias(value)).withColumnRenamed("__group", number), last // FAN)
        return own.join(sums.select(F.col(number).alias("__group"), F.col(name).alias("__lower")), "__group").withColumn(name, F.col(name) + F.col("__lower")).drop("__group", "__lower")

    return level(files, last)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in f(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) if not isinstance(columns[x.name], pa.Array) else columns[x.name].cast(x.type) for x in target], schema=target)

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, text_col: str, good: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows for whose texts ``good`` is true, with all their columns, whatever their names.

    good: from the bytes of several texts and the bounds between them to a mark
    for each.  Rows are filtered where they are; nothing is joined.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in slices(batch, "text"):
                yield part.select(["row"]).filter(pa.array(good(data, bounds)))

    return rows.mapInArrow(run, StructType([StructField("row", docs.schema)])).select("row.*")
