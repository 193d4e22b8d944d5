"""What the operators of this subpackage share: tables, the shared folder, and column names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: What an Arrow batch may hold; by rows alone ten thousand texts, or sets of them, of any size would be one batch.
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data set at `sf_dir` (any path Spark can read); bounds the session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that driver and executors share")
        found = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path below the shared folder, for a table or archive that an operator writes."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back, so that later jobs start from files."""
    spark = df.sparkSession
    path = work_path(spark, kind)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator stores and no longer reads once it has returned; `clear` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, kind: str, **options: str) -> DataFrame:
        self.paths.append(path := work_path(self.spark, kind))
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            removed(self.spark, path)
        self.paths = []


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that `work_path` named, in whatever file system it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df.checkpoint()` in the shared folder: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def others(df: DataFrame, reserved: Iterable[str]) -> list[str]:
    """Columns of `df` whose names, compared without case as Spark does, clash with none of `reserved`."""
    taken = {name.lower() for name in reserved}
    return [c for c in df.columns if c.lower() not in taken]


def unused(name: str, df: DataFrame) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def renamed_apart(df: DataFrame, reserved: Iterable[str]) -> DataFrame:
    """`df` without the columns that an operator is about to add under the same names."""
    return df.select(*[F.col(f"`{c}`") for c in others(df, reserved)])
