"""Reading trace tables: tolerant CSV, several roots, provenance, member folders.

Schemas are given, so nothing is inferred. Every column is text on disk; blank
counts as null. Columns are read by the names in each file's own header, whatever
their order (case, blanks around a name and a byte order mark don't count): a line a
file is read first, and files of equal headers together. Columns that an old file
lacks are null, unknown ones are not read, a row with fewer fields than its file's
header is left out, and a root without the file, or with an empty one, adds no rows.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from worktide.functions import text

# The columns of the trace tables.
SCHEMAS = {
    "mail": "box time sender subject conversation rcv time_precision",
    "calendar": "start end all_day busy_status subject categories location response meeting_status",
    "files": "mtime ext size_kb folder name author",
    "recent": "mtime ext size_kb folder name src target_mtime",
    "git_commits": "time repo subject files insertions deletions branch",
    "chats": "time from summary replied_time chat kind",
    "activity": "time process title idle_sec solvers_running user host",
    "pc_on": "date on_hours first_on last_off night_hours weekend",
    "pc_spans": "start end src",
    "worklog": "date category hours entity note user",
    "license": "poll server feature user host start",
}
CORRUPT = "_short"


@dataclass(frozen=True)
class Typed:
    """How columns of a trace table are read: times, numbers."""

    times: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()


# Which columns of which table are times and numbers.
TYPES = {
    "mail": Typed(("time",)),
    "calendar": Typed(("start", "end"), ("busy_status", "response", "meeting_status")),
    "files": Typed(("mtime",), ("size_kb",)),
    "recent": Typed(("mtime", "target_mtime"), ("size_kb",)),
    "git_commits": Typed(("time",), ("files", "insertions", "deletions")),
    "chats": Typed(("time", "replied_time")),
    "activity": Typed(("time",), ("idle_sec",)),
    "pc_on": Typed(("date",), ("on_hours", "night_hours", "weekend")),
    "pc_spans": Typed(("start", "end")),
    "worklog": Typed(("date",), ("hours",)),
    "license": Typed(("poll", "start")),
}


def headers(spark: SparkSession, path: str, encoding: str = "UTF-8") -> dict[str, tuple[str, ...]]:
    """The files that a path or pattern meets, in whatever store, with the names in
    their first lines: one line a file crosses to the driver."""
    java = spark.sparkContext._jvm.java.io
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for status in files.globStatus(place) or ():
        reader = java.BufferedReader(java.InputStreamReader(files.open(status.getPath()), encoding))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if line and line.strip("\ufeff "):
            out[status.getPath().toString()] = tuple(n.strip().lower() for n in next(csv.reader([line.lstrip("\ufeff")])))
    return out


def read_csv(spark: SparkSession, paths: list[str], table: str, encoding: str = "UTF-8") -> DataFrame:
    """The rows of one trace table in several places, all text, with _path."""
    columns = SCHEMAS[table].split()
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        for file, names in headers(spark, path, encoding).items():
            groups.setdefault(names, []).append(file)
    out = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_path")]))
    for names, files in groups.items():
        place = {n: i for i, n in reversed(list(enumerate(names)))}  # of equal names the first
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(CORRUPT, T.StringType())])
        reader = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        rows = reader.option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(files)
        whole = F.col(CORRUPT).isNull() & (F.length(F.concat_ws("", *schema.names[:-1])) >= 0)  # Spark refuses a plan that reads the corrupt column alone
        value = lambda c: text.blank_to_null(F.col(f"c{place[c]}")) if c in place else F.lit(None).cast("string")  # noqa: B023, E731
        out = out.union(rows.where(whole).select(*(value(c).alias(c) for c in columns), F.col("_metadata.file_path").alias("_path")))
    return out


def typed(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with times and numbers; what does not parse is null."""
    kinds = TYPES[table]
    return rows.withColumns({c: text.strict_timestamp(F.col(c)) for c in kinds.times} | {c: F.col(c).try_cast("double") for c in kinds.numbers})


def format_errors(rows: DataFrame, table: str) -> DataFrame:
    """How many values of each time or number column are there but do not parse."""
    kinds = TYPES[table]
    bad = {c: F.col(c).isNotNull() & text.strict_timestamp(F.col(c)).isNull() for c in kinds.times} | {c: F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() for c in kinds.numbers}
    counts = rows.agg(*(F.count_if(b).alias(c) for c, b in bad.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in bad))).alias("e")).select("e.*")


def multi_root(spark: SparkSession, roots: list[str], table: str) -> DataFrame:
    """One table of several machines: union of the roots, with _root."""
    rows = read_csv(spark, [f"{r.rstrip('/')}/{table}.csv" for r in roots], table)
    return rows.withColumn("_root", F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1))


def file_events(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Files and recent documents, each with its history, told apart by flags."""
    parts = []
    for name, recent in (("files", False), ("recent", True)):
        for suffix, history in (("", False), ("_history", True)):
            rows = read_csv(spark, [f"{r.rstrip('/')}/{name}{suffix}.csv" for r in roots], name)
            parts.append(typed(rows, name).withColumns({"_recent": F.lit(recent), "_history": F.lit(history)}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def power_spans(rows: DataFrame) -> DataFrame:
    """Machine-on spans that end after they begin."""
    return typed(rows, "pc_spans").where(F.col("start") < F.col("end"))


def member_json(spark: SparkSession, share: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Members, one JSON file in each person's folder, and the folders whose file
    does not parse: one broken file costs one person only."""
    lines = spark.read.option("wholetext", True).text(f"{share.rstrip('/')}/*/member.json").select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder"))
    read = lines.withColumn("m", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.try_parse_json("value").isNotNull()
    return read.where(good).select("folder", "m.*"), read.where(~good).select("folder")


def best_file(files: DataFrame, owner: str, total: Column, official: Column, modified: Column) -> DataFrame:
    """For each owner the file whose total is nearest to the official one, the
    newest of equals, then the first path. files: owner, path."""
    return files.groupBy(owner).agg(F.min_by("path", F.struct(F.abs(total - official), -F.unix_micros(modified.cast("timestamp")), F.col("path"))).alias("path"))


def repaired_mm(mm: Column, share: Column, total: Column) -> Column:
    """Man-months as written, else share times the total."""
    return F.coalesce(mm.try_cast("double"), F.round(share.try_cast("double") * total, 3))


def refined_or_plain(plain: DataFrame, refined: DataFrame, key: str, modified: str) -> DataFrame:
    """The refined rows of a key where they are not older than the plain ones."""
    fresh = refined.groupBy(key).agg(F.max(modified).alias("_r")).join(plain.groupBy(key).agg(F.max(modified).alias("_p")), key, "left")
    keys = fresh.where(F.col("_p").isNull() | (F.col("_r") >= F.col("_p"))).select(key)
    return refined.join(keys, key, "left_semi").unionByName(plain.join(keys, key, "left_anti"), allowMissingColumns=True)
