"""Written intermediates in the folder that the cluster shares, and joins that survive a key with most of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys met by broadcast are those with at least this share of the rows, so there are at most 1 / HOT of them.
HOT = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder under /tmp only where a local session names none (tests, bench)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "/tmp/pressgauge-checkpoints").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*frames: DataFrame) -> None:
    """Delete the files behind ``saved`` frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            parent = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


def hot_keys(left: DataFrame, key: str, rows: int) -> DataFrame:
    """Keys of ``left`` with a thousandth of ``rows`` or more: at most a thousand, counted with a map-side combine."""
    counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    return saved(counts.filter((F.col("__n") >= max(rows * HOT, 2)) & F.col(key).isNotNull()).select(key), "hot")


def hot_join(left: DataFrame, right: DataFrame, key: str | list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (at most one row a key); ``hot_keys`` meet by broadcast, so no task gets a whole hot group."""
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    many = left.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return many.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))
