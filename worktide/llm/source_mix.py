"""Mixing sources to target weights by weighted fair queueing.

The total budget is the size of the whole corpus. Sources, in code point order
with null last, weigh 5, 2, 1, repeating (or as given); each is due the budget's
share of its weight, but at most ``max_repeats`` times its own size, and what a
capped source leaves is shared again by weight. With sources sorted by their cap
per unit of weight, one prefix sum finds the level at which that sharing ends.

Documents are shuffled by a seeded hash. The virtual finish time of a document's
copy is the running size of its source up to and with that copy, divided by the
source's target, so all sources advance at the rate of their targets. All copies,
``max_repeats`` a document, are range-sorted by finish time (ties by the shuffle,
then by the row); each range's words give its offset, and the order is cut before
the first copy that does not fit the budget. That copy's place is one row: a
document is taken once for each of its copies in front of it.

Running sums are taken in two levels: by (source, slice of the hash) and within a
slice for the finish times, so a source with most of all rows is many small
windows; by range and within the one range that the budget ends in for the cut.
Only the tables of sources and of ranges, one row each, are ever ordered as a
whole. The ranges are written once, as sums and cut must see the same ones.
DataFrame functions only.

Null text has size 0, a null source is a source. Rows that repeat are mixed as
separate documents; where they tie in every column they are interchangeable, so
reruns agree. No rows give no rows. Extra columns are carried by
``materialise`` and otherwise ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from worktide.llm._common import WORD, n_partitions, saved

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20240601
#: Rows of a (source, slice) window to aim at, and the fewest slices.
SLICE_ROWS, LEAST_SLICES = 100_000, 1024
IDENTITY = ("mix_id", "mix_text", "mix_source", "mix_row")
#: The global order of copies.
ORDER = ("mix_time", "draw", *IDENTITY, "reach")


def identity(docs: DataFrame, row: str = "") -> list:
    """The columns that tell rows apart, none of them null; row: "struct."."""
    text, source = F.col(f"{row}text"), F.col(f"{row}source")
    rest = []
    for c in (c for c in docs.columns if c not in ("doc_id", "text", "source")):
        value, kind = F.col(f"{row}`{c}`"), docs.schema[c].dataType.typeName()
        if kind in ("struct", "array", "map"):  # maps have no hash, and hashes pass over nulls inside
            value = F.to_json(F.struct(value), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
        rest += [value, value.isNull()]
    return [
        F.coalesce(F.col(f"{row}doc_id").cast("string"), F.lit("")).alias("mix_id"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("mix_text"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("mix_source"),
        F.xxhash64(F.col(f"{row}doc_id").isNull(), *rest).alias("mix_row"),
    ]


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(mix_source, source, source_size) -> the same with each source's target."""
    whole = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(whole.orderBy(F.asc_nulls_last("source"))))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_repeats
    by_cap = whole.orderBy(cap / F.col("weight"), "place")
    levelled = weighted.withColumns(
        {
            "budget": F.sum("source_size").over(whole),
            "below": F.coalesce(F.sum(cap).over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "above": F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("budget") - F.col("below")) / F.col("above"))
    level = F.min(F.when(F.col("level") <= cap / F.col("weight"), F.struct(cap / F.col("weight"), "place", "level"))).over(whole)["level"]
    return levelled.withColumn("target", F.least(cap.cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("mix_source", "source_size", "target", "budget")


def weighted_fair_mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """One row per document: the identity columns, doc_id, size, source_size,
    target (its source's), copies (times the mix takes it), taken (words) and
    finish (virtual finish time of its first copy)."""
    rows = saved(
        docs.select(*identity(docs), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).withColumn(
            "draw", F.xxhash64(F.lit(seed), "mix_id", "mix_text")
        )
    )
    slices = LEAST_SLICES
    while slices * SLICE_ROWS < rows.count() // 3 and slices < 1 << 20:  # the count is in the files' footers
        slices *= 2
    rows = rows.withColumn("slice", F.shiftrightunsigned("draw", 64 - (slices.bit_length() - 1)))
    per_slice = rows.groupBy("mix_source", "slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source"))
    targets = source_targets(per_slice.groupBy("mix_source").agg(F.sum("slice_size").alias("source_size"), F.first("source").alias("source")), weights, max_repeats)
    before = F.sum("slice_size").over(W.partitionBy("mix_source").orderBy("slice")) - F.col("slice_size")
    offsets = per_slice.withColumn("before", before).join(targets, "mix_source").drop("source", "slice_size")
    own = F.sum("size").over(W.partitionBy("mix_source", "slice").orderBy("draw", *IDENTITY).rowsBetween(W.unboundedPreceding, 0))
    placed = saved(rows.withColumn("own", own).join(offsets, ["mix_source", "slice"]).withColumn("reach", F.col("own") + F.col("before")).drop("own", "before", "slice", "source"))

    whole, due = F.col("source_size"), F.col("target") > 0
    placed = placed.withColumns({"finish": F.when(due, F.col("reach") / F.col("target")).otherwise(F.lit(0.0)), "lap": F.when(due, whole / F.col("target")).otherwise(F.lit(0.0))})
    times = F.transform(F.sequence(F.lit(0), F.when(F.col("size") > 0, max_repeats - 1).otherwise(0)), lambda k: F.col("finish") + k * F.col("lap"))
    placed = placed.withColumn("times", times)
    found = cut(placed.withColumn("mix_time", F.explode("times")).select(*ORDER, "size", "budget"))
    ends = found.first()["ends"]  # one row
    place = lambda t: F.struct(t.alias("mix_time"), *ORDER[1:])
    stop = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(ends or (), found.schema["ends"].dataType)))
    taken = F.size(F.filter("times", lambda t: place(t) < stop) if ends else F.col("times"))
    out = placed.withColumn("copies", taken)
    return out.select(*IDENTITY, "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "finish", "lap", "draw", "reach")


def cut(copies: DataFrame) -> DataFrame:
    """One row: ``ends``, the place in ORDER of the first copy that does not fit
    the budget (null if all fit)."""
    n = n_partitions(copies.sparkSession)
    ranged = saved(copies.repartitionByRange(n, *ORDER).withColumn("range", F.spark_partition_id()))
    in_order = W.partitionBy(F.lit(0)).orderBy("range")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("words"), F.first("budget").alias("all")).withColumn("before", F.sum("words").over(in_order) - F.col("words"))
    last = sums.where((F.col("before") <= F.col("all")) & (F.col("before") + F.col("words") > F.col("all"))).select("range", "before")  # one row at most
    running = F.col("before") + F.sum("size").over(W.partitionBy("range").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    return ranged.join(F.broadcast(last), "range").withColumn("running", running).agg(F.min(F.when(F.col("running") > F.col("budget"), F.struct(*ORDER))).alias("ends"))


def materialise(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mix itself: the taken documents with all their columns, once a copy,
    range-partitioned and sorted by virtual finish time.

    One shuffle meets documents with decisions, one sorts. Rows that are the same
    in every column go once to the join, where each of their decisions meets them.
    """
    own = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("mix_rest")).select("mix_rest", *identity(docs, "mix_rest."))
    once = keyed.groupBy(*IDENTITY).agg(F.first("mix_rest").alias("mix_rest"))
    times = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.col("finish") + k * F.col("lap"))
    chosen = mix.where("copies > 0").select(*IDENTITY, "draw", "reach", times.alias("mix_times"))
    copies = once.join(chosen, list(IDENTITY)).select("mix_rest", F.explode("mix_times").alias("mix_time"), *ORDER[1:])
    n = n_partitions(docs.sparkSession)
    return copies.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).select(*(F.col("mix_rest").getField(c).alias(c) for c in own))
