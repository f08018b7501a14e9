"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word of the text contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that saved() has made, by application, for release().
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Where the session names none, as in tests, a local session's is under /tmp;
    on a cluster that would be each machine's own disk, so it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "/tmp/checkpoints"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches by bytes where it sets no
    bound itself: rows hold whole texts, so a number of rows bounds no memory."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs no more than the tasks it was running. The folder
    stays until release()."""
    spark = df.sparkSession
    path = shared_dir(spark)
    folders(spark).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession) -> list[str]:
    """The folders that saved() has written in this session and that are still there."""
    return _made.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, keep: DataFrame, before: list[str]) -> None:
    """Remove the folders that saved() wrote beside those of ``before``, but for
    the one that ``keep``, itself a saved table, reads. Call it when no other
    result of that time is read any more."""
    made, files = folders(spark), keep.inputFiles()
    for path in set(made) - set(before) if files else ():
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            made.remove(path)


#: Rows of one key below which it is never dealt out.
HOT_ROWS = 1_000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``rows`` joined with ``keyed``, a saved table that has each key once and its
    number of rows as n (left out of the result).

    A key with more than a quarter of an even partition's rows is dealt into as
    many pieces as it holds such quarters, by a hash of the columns ``spread``: at
    most 4 keys and 8 pieces a partition, so the keys' table may be broadcast. One
    key of a single piece is always in it: the plan is the same at every size."""
    total = keyed.agg(F.sum("n")).first()[0] or 0
    piece = max(HOT_ROWS, total // (4 * n_partitions(rows.sparkSession)))
    pieces = F.ceil(F.col("n") / piece).cast("int")
    found = keyed.where(F.col("n") > piece).select(*keys, pieces.alias("hot_pieces"))
    one = rows.sparkSession.range(1).select(*(F.lit("0").cast(found.schema[k].dataType).alias(k) for k in keys), F.lit(1).alias("hot_pieces"))
    hot = found.union(one).groupBy(*keys).agg(F.max("hot_pieces").alias("hot_pieces"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("hot_piece", F.coalesce(F.pmod(F.xxhash64(*spread), "hot_pieces"), F.lit(0)).cast("int")).drop("hot_pieces")
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > piece, pieces - 1).otherwise(0)))
    return dealt.join(keyed.withColumn("hot_piece", each).drop("n"), [*keys, "hot_piece"]).drop("hot_piece")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
