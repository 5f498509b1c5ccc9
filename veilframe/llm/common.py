"""Helpers that the training-data operators share: tables, checkpoints, words."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space and the ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Stands in for a null id while rows are ordered or joined: after all real ids.
NULL_ID = 2**63 - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names in spark.checkpoint.dir.

    Where that is unset, a local temporary folder serves a local master; on a
    cluster it raises, as executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_veilframe_folder", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="veilframe-")
            spark._veilframe_folder = folder
    return folder


#: Makes Spark remove the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame | list[DataFrame], name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    It cuts the lineage: what stands below is not run again when an executor
    is lost or when two branches need the rows. So shuffle files of the write are
    of no more use and are removed at its end; the setting is put back after it.
    Of a list, each is written after the other into one table: only the shuffle files
    of one are there at a time.
    """
    parts = df if isinstance(df, list) else [df]
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(parts[0].schema).parquet(path)
    out._veilframe_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._veilframe_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def id_key(column: str = "doc_id"):
    """doc_id as a long, null as the largest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def back_to_id(column: str):
    return F.when(F.col(column) != NULL_ID, F.col(column))


def row_tag(docs: DataFrame) -> Column:
    """What tells apart rows of docs that have one doc_id, or none: a hash of the text.

    Rows that repeat both are one document: they stay or go together. Where no
    doc_id is null or repeated, which one pass over the ids tells, it is 0.
    """
    repeated = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")) if repeated else F.lit(0).cast("long")


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], held: str, total: int, how: str = "inner", parts: int = 1000, least: int = 0) -> DataFrame:
    """rows joined with table, which has each key once and, in held, the number of rows of that key.

    Keys that hold over a part of total are at most `parts` in number, whatever the
    data: these are broadcast, so that no task gets all rows of one. The rest is shuffled.
    Of fewer rows than least in all, no key is too much for a task.
    """
    if total < least:
        return rows.join(table.drop(held).hint("merge"), key, how)
    hot, cold = table.where(F.col(held) > total / parts).drop(held), table.where(F.col(held) <= total / parts).drop(held)
    found = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold.hint("merge"), key, how)
    return found.unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Shared:
    """A bounded object sent once to each executor, with the code of its class."""

    def __init__(self, spark: SparkSession, obj):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(obj))

    @property
    def value(self):
        return pickle.loads(self.sent.value)
