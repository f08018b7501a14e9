"""Writing results: partitions by period tag or owner, JSON bundles, ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``rows`` holds and leave the others. The
    committer publishes files at the end of the job, never half a table."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_ledger(rows: DataFrame, path: str, tag: str) -> None:
    """Add rejected rows under a tag."""
    rows.withColumn("tag", F.lit(tag)).write.mode("append").partitionBy("tag").parquet(path)


def bundles(rows: DataFrame, owner: str) -> DataFrame:
    """One JSON document for each owner: (owner, bundle). An owner's rows are a
    person's result table, not raw traces."""
    rest = [c for c in rows.columns if c != owner]
    return rows.groupBy(owner).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("bundle"))


def stale(written: DataFrame, inputs: DataFrame, key: str, modified: str) -> DataFrame:
    """Keys whose results are older than their newest input."""
    newest = inputs.groupBy(key).agg(F.max(modified).alias("_newest"))
    return written.join(newest, key).where(F.col(modified) < F.col("_newest")).select(key)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the cluster shares for checkpoints and read
    back: lineage ends there, and a lost executor costs no finished work."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "/tmp/checkpoints"
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
