"""Sessions, pairings and episodes over ordered traces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from worktide.functions.config import Settings
from worktide.operators.signals import is_night


def visit_sessions(points: DataFrame, keys: list[str], at: str, gap_min: float, tail_min: float) -> DataFrame:
    """Runs of points at most gap_min apart, from the first to tail_min past the last."""
    along = W.partitionBy(*keys).orderBy(at)
    apart = F.timestamp_diff("MICROSECOND", F.lag(at).over(along), F.col(at)) > int(gap_min * 60e6)
    marked = points.select(*keys, at).withColumn("_new", F.when(apart, 1).otherwise(0))
    runs = marked.withColumn("session", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    ends = F.max(at) + F.expr(f"INTERVAL {int(tail_min * 60)} SECONDS")
    return runs.groupBy(*keys, "session").agg(F.min(at).alias("start"), ends.alias("end"), F.count(F.lit(1)).alias("points")).drop("session")


def signal_sessions(signals: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("owner", "day")) -> DataFrame:
    """keys, a, b, active: a day's signals folded into sessions.

    Each signal covers its label's width around its minute. It joins the running
    session if it touches it, or, when it and the session are both active, if it
    begins within the session gap. Night signals that are not productive and
    labels without width make no session. Sessions are clipped to the day.
    A fold, as whether a gap is bridged depends on all before it: one sorted
    array for each owner and day. A repeated signal changes no session, so the
    array holds each minute and label once, which a day's length bounds.
    """
    half = F.greatest(F.lit(2.5), F.col("width") / 2)
    used = signals.where((F.col("width") > 0) & (~is_night(F.col("minute"), settings) | F.col("productive")))
    item = F.struct(F.col("minute").alias("m"), F.col("source").alias("s"), (F.col("minute") - half).alias("a"), (F.col("minute") + half).alias("b"), F.col("active").alias("active"))
    days = used.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("items"))
    span = "struct<a: double, b: double, active: boolean>"
    start = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(None).cast(span).alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        reach = F.when(x["active"] & cur["active"], F.lit(settings.session_gap_min)).otherwise(F.lit(0.0))
        joins = cur.isNotNull() & (x["a"] - cur["b"] <= reach)
        joined = F.struct(F.least(cur["a"], x["a"]).alias("a"), F.greatest(cur["b"], x["b"]).alias("b"), (cur["active"] | x["active"]).alias("active"))
        fresh = F.struct(x["a"].alias("a"), x["b"].alias("b"), x["active"].alias("active"))
        done = F.when(joins | cur.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))
        return F.struct(done.alias("done"), F.when(joins, joined).otherwise(fresh).cast(span).alias("cur"))

    folded = F.aggregate("items", start, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    spans = days.select(*keys, F.explode(folded).alias("s"))
    clipped = spans.select(*keys, F.greatest(F.col("s.a"), F.lit(0.0)).alias("a"), F.least(F.col("s.b"), F.lit(1440.0)).alias("b"), F.col("s.active").alias("active"))
    return clipped.where("a < b")


def cap_passive(spans: DataFrame, most: float, keys: tuple[str, ...] = ("owner", "day")) -> DataFrame:
    """Passive spans cut, in order of time, to ``most`` minutes a day."""
    length = F.when(F.col("active"), 0.0).otherwise(F.col("b") - F.col("a"))
    before = F.coalesce(F.sum(length).over(W.partitionBy(*keys).orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    room = F.greatest(F.lit(0.0), F.lit(float(most)) - before)
    return spans.withColumn("_room", room).withColumn("b", F.when(F.col("active"), F.col("b")).otherwise(F.least("b", F.col("a") + F.col("_room")))).where("a < b").drop("_room")


def next_matching(rows: DataFrame, keys: list[str], order: list[str], holds: Column, value: Column, name: str) -> DataFrame:
    """As-of join forward: the value of the first later row for which ``holds``. The
    rows run backwards, so that the last match seen is kept and no frame is read anew."""
    later = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(holds, value), ignorenulls=True).over(later))


def order_to_done(rows: DataFrame, keys: list[str], at: str, is_order: Column, is_done: Column, days: int) -> DataFrame:
    """Each order with the first done row of its key after it, within ``days``;
    of several orders with one done row the shortest lead stays."""
    paired = next_matching(rows, keys, [at], is_done, F.col(at), "done_at").where(is_order & F.col("done_at").isNotNull())
    lead = F.timestamp_diff("MICROSECOND", F.col(at), F.col("done_at"))
    near = paired.withColumn("lead_h", F.round(lead / 3600e6, 2)).where(lead <= days * 86_400_000_000)
    return near.groupBy(*keys, "done_at").agg(F.max(at).alias("order_at"), F.min("lead_h").alias("lead_h"))


def order_to_shared_done(rows: DataFrame, keys: list[str], at: str, words: str, is_order: Column, is_done: Column, days: int) -> DataFrame:
    """Each order with the first done row of its key within ``days`` that shares a word
    with it; of several orders with one done row the shortest lead stays. Orders and
    done rows of a key and word run backwards together, each order taking the done row
    seen last, so that nothing is paired: the work grows with the rows."""
    each = rows.select(*keys, F.col(at).alias("_at"), is_order.alias("_order"), is_done.alias("_done"), F.explode(F.array_distinct(words)).alias("_word")).where("_order OR _done")
    back = W.partitionBy(*keys, "_word").orderBy(F.desc("_at"), F.col("_done")).rowsBetween(W.unboundedPreceding, -1)
    lead = F.timestamp_diff("MICROSECOND", F.col("order_at"), F.col("done_at"))
    done = F.last(F.when(F.col("_done"), F.col("_at")), ignorenulls=True).over(back)
    met = each.withColumn("done_at", done).where("_order").select(*keys, F.col("_at").alias("order_at"), "done_at").where((lead > 0) & (lead <= days * 86_400_000_000))
    paired = met.groupBy(*keys, "order_at").agg(F.min("done_at").alias("done_at"))
    return paired.groupBy(*keys, "done_at").agg(F.max("order_at").alias("order_at")).withColumn("lead_h", F.round(lead / 3600e6, 2))


def episodes(rows: DataFrame, keys: list[str], day: str, gap_days: int) -> DataFrame:
    """Runs of active days with at most ``gap_days`` whole days between them."""
    along = W.partitionBy(*keys).orderBy(day)
    days = rows.select(*keys, day).distinct()
    marked = days.withColumn("_new", F.when(F.date_diff(day, F.lag(day).over(along)) - 1 > gap_days, 1).otherwise(0))
    runs = marked.withColumn("episode", F.sum("_new").over(along) + 1)
    return runs.groupBy(*keys, "episode").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("active_days"))


def gap_runs(rows: DataFrame, keys: list[str], day: str, calendar: DataFrame, least: int) -> DataFrame:
    """Runs of at least ``least`` calendar days in a row without a row.

    calendar: (day, n) with n counting its days, so that runs skip weekends.
    Each key's span of evidence bounds its calendar.
    """
    ends = rows.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    have = rows.select(*keys, F.col(day).alias("day")).distinct()
    spine = ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("day")).join(calendar.select("day", "n"), "day")
    missing = spine.join(have, [*keys, "day"], "left_anti")
    island = F.col("n") - F.row_number().over(W.partitionBy(*keys).orderBy("n"))
    return missing.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.count(F.lit(1)).alias("days")).where(F.col("days") >= least).drop("_i")


def power_spans(events: DataFrame, keys: list[str], at: str, kind: str, cap_hours: float = 20.0, boot_after_min: float = 30.0) -> DataFrame:
    """On/off pairing: an on row opens unless one is open; off closes; a boot
    more than ``boot_after_min`` after the opening closes an open span at most
    ``cap_hours`` after it and opens anew. kind holds on, off or boot.

    Rows stream in order of key and time past one open span, so a key's rows are
    never held together, however many there are.
    """
    old, cap = int(boot_after_min * 60) + 1, int(cap_hours * 3600) * 1_000_000
    rows = events.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("timestamp_ntz").alias("_t"), F.col(kind).alias("_k"))
    schema = StructType([rows.schema[k] for k in keys] + [StructField(c, TimestampNTZType()) for c in ("start", "end")])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened = None, None
        for batch in batches:
            at_us, kinds = batch["_t"].cast(pa.int64()).to_pylist(), batch["_k"].to_pylist()
            places, starts, ends = [], [], []
            for i, key in enumerate(zip(*(batch[k].to_pylist() for k in keys))):
                if key != current:
                    current, opened = key, None
                t, k = at_us[i], kinds[i]
                if opened is not None and (k == "off" or (k == "boot" and (t - opened) // 1_000_000 >= old)):
                    if opened < t:
                        places.append(i)
                        starts.append(opened)
                        ends.append(min(t, opened + cap))
                    opened = None
                if k != "off" and opened is None:
                    opened = t
            own = [batch[k].take(pa.array(places, pa.int64())) for k in keys]
            times = [pa.array(x, pa.int64()).cast(pa.timestamp("us")) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays(own + times, names=[*keys, "start", "end"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "_t", "_k").mapInArrow(pair, schema)
