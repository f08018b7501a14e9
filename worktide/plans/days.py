"""Queries on calendar, worklog and machine days, each with the SQL that checks it.

The calendar is made from orders and events: every rule's values occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from worktide.functions.config import Settings
from worktide.operators import calendar_days as C, hours, intervals, machine, sessions, signals, solver_nights as N, whole_days as D
from worktide.plans import oracles

S = Settings()
FIRST, LAST = "1990-01-01", "2099-12-31"
SUBJECTS = ("team meeting", "day off", "half day off", "canceled: review", "site visit", "seminar", "vacation statistics", "report")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark, sf) -> DataFrame:
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    start = F.timestamp_add("MINUTE", k * 37 % 1440, day)
    return o.select(
        F.col("o_custkey").alias("owner"), start.alias("start"), F.timestamp_add("MINUTE", k * 53 % 3000 - 60, start).alias("end"), (k % 11 == 0).alias("all_day"),
        F.when(k % 6 < 5, (k % 6).cast("int")).alias("busy"), F.when(k % 7 < 6, (k % 7).cast("int")).alias("response"),
        F.element_at(F.array(*(F.lit(x).cast("int") for x in (0, 1, 3, 5, 7, None))), (k % 13 % 6 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*map(F.lit, SUBJECTS)), (k % 17 % 8 + 1).cast("int")).alias("subject"),
    )


_ENTRIES = f"""raw AS (
  SELECT o_custkey AS owner, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(CAST(o_orderkey * 37 % 1440 AS BIGINT)) AS s FROM orders
), entry AS (
  SELECT owner, k, s, s + to_minutes(CAST(k * 53 % 3000 - 60 AS BIGINT)) AS e, k % 11 = 0 AS all_day,
    CASE WHEN k % 6 < 5 THEN k % 6 END AS busy, CASE WHEN k % 7 < 6 THEN k % 7 END AS response,
    [0, 1, 3, 5, 7, NULL][k % 13 % 6 + 1] AS status, {list(SUBJECTS)!r}[k % 17 % 8 + 1] AS subject FROM raw
), ruled AS (
  SELECT *, (epoch(e) - epoch(s)) / 60.0 AS mins, coalesce(busy, 2) AS b2, coalesce(response, -1) AS r1, coalesce(status, -1) AS s1,
    subject IN ('day off', 'half day off') AS leave, subject = 'seminar' AS training, subject IN ('site visit', 'seminar') AS away, subject = 'half day off' AS half,
    subject LIKE 'canceled%' OR coalesce(response, -1) = 4 OR (coalesce(busy, 2) = 0 AND coalesce(response, -1) NOT IN (1, 3)) OR (coalesce(response, -1) = 2 AND coalesce(busy, 2) = 1) AS skip
  FROM entry
), judged AS (SELECT *, s1 = 0 OR (status IS NULL AND mins > 300 AND NOT away) AS block FROM ruled)"""


def meeting_spans(spark, sf):
    """Minutes a day of meetings and of blocks."""
    spans = C.meeting_spans(entries(spark, sf), FIRST, LAST, words=C.Words(), settings=S)
    minutes = F.round(F.sum(F.col("b") - F.col("a")), 2).alias("minutes")
    return spans.groupBy("owner", "day", "block").agg(minutes, F.count(F.lit(1)).alias("pieces"), F.max("accepted").alias("accepted"), F.max("carried").alias("carried"))


def calendar_absence_days(spark, sf):
    return C.absence_days(entries(spark, sf), FIRST, LAST)


def offsite_days(spark, sf):
    return C.offsite_days(entries(spark, sf), FIRST, LAST)


def manual_hours(spark, sf):
    e = _t(spark, sf, "events")
    log = e.select(F.col("user_id").alias("owner"), F.to_date("ts").alias("day"), F.col("event_type").alias("category"), F.when(F.col("event_id") % 3 == 0, " x ").otherwise("x").alias("entity"), F.lit(None).cast("string").alias("note"), ((F.col("event_id") % 60 - 5) / 2.0).alias("hours"))
    return C.manual_hours(log, FIRST, LAST)


def machine_spans(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events").where("event_type IN ('signup', 'click')")
    spans = e.select(F.col("user_id").alias("owner"), (F.col("event_id") % 3).alias("root"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("s"))
    cut = spans.withColumn("e", F.timestamp_add("MINUTE", F.col("owner") * 37 % 500 + 30, F.col("s")))
    return intervals.midnight_split(cut, "s", "e").select("owner", "root", "day", "a", "b")


def machine_rows(spark, sf) -> DataFrame:
    e, k = _t(spark, sf, "events").where("event_type IN ('purchase', 'view')"), F.col("event_id")
    first = k * 7 % 900
    return e.select(
        F.col("user_id").alias("owner"), (k % 3).alias("root"), F.to_date("ts").alias("day"), F.when(k % 2 == 0, k % 500 / 60.0).otherwise((k % 270 - 10) / 10.0).alias("on_h"), (k % 30 / 10.0).alias("night_h"),
        first.cast("double").alias("first_min"), (first + k % 500 - F.when(k % 17 == 0, 600).otherwise(0)).cast("double").alias("last_min"),
    )


_MACHINE = """ms AS (
  SELECT user_id AS owner, event_id % 3 AS root, date_trunc('minute', ts) AS s, date_trunc('minute', ts) + to_minutes(CAST(user_id * 37 % 500 + 30 AS BIGINT)) AS e FROM events WHERE event_type IN ('signup', 'click')
), md AS (SELECT owner, root, s, e, CAST(UNNEST(generate_series(date_trunc('day', s), date_trunc('day', e - to_microseconds(1)), INTERVAL 1 DAY)) AS DATE) AS day FROM ms
), mspan AS (SELECT owner, root, day, greatest(epoch(s) - epoch(CAST(day AS TIMESTAMP)), 0) / 60.0 AS a, least(epoch(e) - epoch(CAST(day AS TIMESTAMP)), 86400) / 60.0 AS b FROM md)"""


def _union(source: str) -> str:
    """on, night, first, last of a union of spans, in CTEs that end with u."""
    return f"""um AS (SELECT owner, day, a, b, max(b) OVER (PARTITION BY owner, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE a < b
), ug AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY owner, day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM um
), ui AS (SELECT owner, day, min(a) AS a, max(b) AS b FROM ug GROUP BY owner, day, g
), u AS (SELECT owner, day, round(sum(b - a) / 60, 2) AS on_h, round(sum(b - a - greatest(0.0, least(b, 1140.0) - greatest(a, 480.0))) / 60, 2) AS night_h, min(a) AS first_min, max(b) AS last_min FROM ui GROUP BY owner, day)"""


def daily_from_spans(spark, sf):
    return machine.daily_from_spans(machine_spans(spark, sf).drop("root"), S)


def merged_machine_days(spark, sf):
    own = machine.daily_from_spans(machine_spans(spark, sf).where("root = 0").drop("root"), S)
    return machine.merged_days(own, machine.daily_from_spans(machine_spans(spark, sf).where("root > 0").drop("root"), S))


def power_days(spark, sf):
    return machine.power_days(machine_rows(spark, sf), machine_spans(spark, sf), S)


def sampler_spans(spark, sf):
    """Events as window samples of three owners; one owner's are never idle."""
    e = _t(spark, sf, "events")
    idle = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("event_id") * 7 % 500).cast("double")
    samples = e.select((F.col("user_id") % 3).alias("owner"), F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("minute"), idle.alias("idle"), F.when(F.col("event_id") % 5 < 4, "doc").otherwise(F.col("event_type")).alias("title"))
    spans = hours.sampler_spans(samples, 5.0)
    return spans.groupBy("owner", "day", "kind").agg(F.round(F.sum(F.col("b") - F.col("a")), 2).alias("minutes"), F.count(F.lit(1)).alias("spans"))


def order_shared_done(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("user_id").alias("owner"), "ts", "event_type", F.array(F.concat(F.lit("w"), F.col("event_id") % 20), F.concat(F.lit("w"), F.col("event_id") % 7)).alias("words"))
    return sessions.order_to_shared_done(rows, ["owner"], "ts", "words", F.col("event_type") == "view", F.col("event_type") == "purchase", S.order_done_days)


def calendar_of_events(spark, sf) -> DataFrame:
    """Errors as calendar entries of their users."""
    e, k = _t(spark, sf, "events").where("event_type = 'error'"), F.col("event_id")
    start = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return e.select(
        F.col("user_id").alias("owner"), start.alias("start"), F.timestamp_add("MINUTE", k * 53 % 900 - 60, start).alias("end"), (k % 11 == 0).alias("all_day"),
        F.when(k % 6 < 5, (k % 6).cast("int")).alias("busy"), F.when(k % 7 < 6, (k % 7).cast("int")).alias("response"),
        F.element_at(F.array(*(F.lit(x).cast("int") for x in (0, 1, 3, 5, 7, None))), (k % 13 % 6 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*map(F.lit, SUBJECTS)), (k % 17 % 8 + 1).cast("int")).alias("subject"),
    )


def day_inputs(spark, sf) -> dict[str, DataFrame]:
    """Every input of a day's hours, made from the events. Machines are of six kinds by
    user and date (two measure spans, two keep a window with sleep, one keeps hours
    alone, one nothing); every tenth user's is always on."""
    e = _t(spark, sf, "events")
    sig = signals.signals_of_events(e, S)
    m = F.col("minute").cast("double")
    calendar = calendar_of_events(spark, sf)
    sampled = sig.where("source = 'click'").select("owner", "day", m.alias("m"), (F.second("ts") % 7 * 10 + 20).alias("n"))
    active = sampled.select("owner", "day", F.lit("active").alias("kind"), F.col("m").alias("a"), F.least(F.lit(1440.0), F.col("m") + F.col("n")).alias("b"))
    cover = sampled.select("owner", "day", F.lit("cover").alias("kind"), F.greatest(F.lit(0.0), F.col("m") - 30).alias("a"), F.least(F.lit(1440.0), F.col("m") + 120).alias("b"))
    kind = F.when(F.col("owner") % 10 == 7, 6).otherwise((F.col("owner") + F.dayofmonth("day")) % 6)
    used = sig.groupBy("owner", "day").agg(F.greatest(F.lit(0.0), F.min(m) - 60).alias("a"), F.least(F.lit(1440.0), F.max(m) + 60).alias("b")).withColumn("k", kind)
    used = used.withColumns({"a": F.when(F.col("k") == 6, 0.0).otherwise(F.col("a")), "b": F.when(F.col("k") == 6, 1440.0).otherwise(F.col("b"))})
    low, high = map(float, S.day_window)
    night = F.col("b") - F.col("a") - F.greatest(F.lit(0.0), F.least("b", F.lit(high)) - F.greatest("a", F.lit(low)))
    awake = F.when(F.col("k").isin(2, 3), 0.75).otherwise(1.0)
    timed = F.col("k") != 4
    days = used.where("k <> 5").select("owner", "day", F.when(timed, (F.col("b") - F.col("a")) * awake / 60).otherwise(6.5).alias("on_h"), F.when(timed, night * awake / 60).otherwise(1.0).alias("night_h"), F.when(timed, F.col("a")).alias("first_min"), F.when(timed, F.col("b")).alias("last_min"))
    log = e.where("event_type = 'view'").select(F.col("user_id").alias("owner"), F.to_date("ts").alias("day"), F.lit("c").alias("category"), F.col("event_id").cast("string").alias("entity"), F.lit(None).cast("string").alias("note"), (F.col("event_id") % 23 / 2.0 - 5).alias("hours"))
    return {
        "sessions": sessions.cap_passive(sessions.signal_sessions(sig, S), S.passive_day_max_min).select("owner", "day", "a", "b"), "meetings": C.meeting_spans(calendar, FIRST, LAST, settings=S), "sampler": active.union(cover),
        "machine": used.where("k IN (0, 1, 2, 3, 6)").select("owner", "day", "a", "b", F.col("k").isin(0, 1, 6).alias("measured")), "machine_days": days,
        "points": sig.select("owner", "day", "minute", "productive", ((F.col("source") == "signup") & (F.second("ts") % 2 == 0)).alias("solver")), "solver": N.by_day(N.solver_nights(**night_traces(spark, sf), settings=S)),
        "offsite": C.offsite_days(calendar, FIRST, LAST), "manual": C.manual_hours(log, FIRST, LAST), "absence": C.absence_days(calendar, FIRST, LAST), "leave": C.leave_spans(calendar, FIRST, LAST),
    }


def whole_day_hours(spark, sf):
    """Worked hours by all rules from all inputs, and each day's ledger."""
    return D.whole_days(**day_inputs(spark, sf), settings=S)


def day_anomalies(spark, sf):
    """What the ledger of all days names, by kind and owner."""
    return D.anomaly_ledger(D.whole_days(**day_inputs(spark, sf), settings=S)).groupBy("owner", "kind").agg(F.count(F.lit(1)).alias("days"), F.round(F.sum("hours"), 2).alias("hours"))


def night_traces(spark, sf) -> dict[str, DataFrame]:
    """Events as what a night is made of: signups write outputs for up to 40 minutes,
    purchases are work, views are only looked at, clicks are sampled for 20 minutes."""
    e = _t(spark, sf, "events")
    m = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    at = e.select("event_id", "event_type", F.col("user_id").alias("owner"), F.to_date("ts").alias("day"), m.alias("a"))
    long = lambda kind, more: at.where(F.col("event_type") == kind).select("owner", "day", "a", F.least(F.lit(1440.0), F.col("a") + more).alias("b"))
    return {"outputs": long("signup", F.col("event_id") % 5 * 10.0), "people": long("purchase", F.lit(0.0)), "views": long("view", F.lit(0.0)), "spans": long("click", F.lit(20.0))}


def solver_night_credit(spark, sf):
    """Minutes that solver nights credit to each date, and what became of the cap."""
    nights = N.solver_nights(**night_traces(spark, sf), settings=S)
    dated = nights.withColumn("date", F.floor(F.col("a") / 1440))
    return dated.groupBy("owner", F.date_add(F.lit("1970-01-01").cast("date"), F.col("date").cast("int")).alias("day")).agg(
        F.round(F.sum(F.col("b") - F.col("a")), 2).alias("minutes"), F.count_distinct("night").alias("nights"), F.max("opened").alias("opened"), F.max("capped").alias("capped"), F.min(F.col("a") - F.col("date") * 1440).alias("start")
    )


QUERIES = {f.__name__: f for f in (whole_day_hours, day_anomalies, solver_night_credit, sampler_spans, order_shared_done, meeting_spans, calendar_absence_days, offsite_days, manual_hours, daily_from_spans, merged_machine_days, power_days)}

_NIGHT_ROWS = """ev AS (
  SELECT user_id AS owner, event_type AS kind, (CAST(ts AS DATE) - DATE '1970-01-01') * 1440 + hour(ts) * 60 + minute(ts) AS a, event_id, CAST(ts AS DATE) AS day FROM events
), x AS (SELECT owner, kind, a, CASE kind WHEN 'signup' THEN least(a + event_id % 5 * 10, (a // 1440 + 1) * 1440) WHEN 'click' THEN least(a + 20, (a // 1440 + 1) * 1440) ELSE a END AS b FROM ev
), nights AS (SELECT DISTINCT owner, unnest([a // 1440 - 1, a // 1440]) AS night FROM x WHERE kind = 'signup'
), w AS (SELECT *, night * 1440 + 1140 AS w0, night * 1440 + 1920 AS w1 FROM nights
), o AS (SELECT w.owner, night, w0, w1, min(greatest(a, w0)) AS first, max(least(b, w1)) AS last FROM w JOIN x ON x.owner = w.owner AND x.kind = 'signup' AND b >= w0 AND a < w1 GROUP BY ALL
), s AS (
  SELECT o.owner, night, last, coalesce(max(CASE WHEN kind = 'purchase' AND a >= w0 AND a <= first THEN a WHEN kind = 'click' AND b > w0 AND a <= first THEN least(b, first) END), first) AS start,
    coalesce(bool_or(CASE WHEN kind IN ('purchase', 'view') THEN a > first AND a <= w1 WHEN kind = 'click' THEN b > first AND a < w1 END), false) AS opened
  FROM o LEFT JOIN x ON x.owner = o.owner AND x.kind <> 'signup' AND x.a <= o.w1 AND x.b >= o.w0 GROUP BY o.owner, night, last, first
), c AS (SELECT owner, night, opened, NOT opened AND last - start > 240 AS capped, CASE WHEN NOT opened THEN greatest(start, last - 240) ELSE start END AS a, last AS b FROM s WHERE last > start
), d AS (
  SELECT owner, night, opened, capped, greatest(a, date * 1440) AS a, least(b, (date + 1) * 1440) AS b, date FROM (SELECT *, unnest(range(CAST(floor(a / 1440.0) AS BIGINT), CAST(ceil(b / 1440.0) AS BIGINT))) AS date FROM c)
), f AS (
  SELECT *, CASE WHEN bool_or(opened) OVER q THEN 1440 ELSE 240 END - coalesce(sum(b - a) OVER (q ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM d WINDOW q AS (PARTITION BY owner, date)
), credit AS (SELECT owner, night, opened, capped, date, greatest(a, b - room) AS a, b FROM f WHERE b > greatest(a, b - room))"""


_ERRORS = _ENTRIES.replace(
    "SELECT o_custkey AS owner, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(CAST(o_orderkey * 37 % 1440 AS BIGINT)) AS s FROM orders", "SELECT user_id AS owner, event_id AS k, date_trunc('minute', ts) AS s FROM events WHERE event_type = 'error'"
).replace("k * 53 % 3000 - 60", "k * 53 % 900 - 60")


def _tiles(spans: str, kinds: list[str], name: str) -> str:
    """The pieces between all boundaries of ``spans``, and which kinds cover each."""
    covered = ", ".join(f"bool_or(p.kind = '{k}') AS {k}_" for k in kinds)
    return f"""{name}_m AS (SELECT DISTINCT owner, day, unnest([a, b]) AS m FROM {spans} WHERE a < b
), {name}_g AS (SELECT owner, day, m AS a, lead(m) OVER (PARTITION BY owner, day ORDER BY m) AS b FROM {name}_m
), {name} AS (SELECT g.owner, g.day, g.a, g.b, {covered} FROM {name}_g g JOIN {spans} p ON p.owner = g.owner AND p.day = g.day AND p.a <= g.a AND p.b >= g.b WHERE g.b IS NOT NULL GROUP BY ALL)"""


def _sum(holds: str, name: str, over: str = "q") -> str:
    return f"coalesce(sum(b - a) FILTER ({holds}) OVER {over}, 0) AS {name}"


_X = "floor(({x}) * 100 + 0.5 + 1e-7)::DOUBLE / 100"
_WHOLE_DAYS = f"""{oracles._CAPPED}, {_NIGHT_ROWS}, {_ERRORS}
, held AS (
  SELECT *, CASE WHEN status IS NULL AND response IS NULL THEN b2 IN (2, 3) ELSE s1 IN (1, 3) OR r1 IN (1, 3) END AS acc FROM judged WHERE NOT leave AND NOT skip AND NOT all_day AND e > s AND NOT (training AND b2 NOT IN (2, 3) AND r1 NOT IN (1, 3))
), hd AS (SELECT *, CAST(UNNEST(generate_series(date_trunc('day', s), date_trunc('day', e - to_microseconds(1)), INTERVAL 1 DAY)) AS DATE) AS day FROM held
), hp AS (SELECT *, greatest(epoch(s) - epoch(CAST(day AS TIMESTAMP)), 0) / 60.0 AS a0, least(epoch(e) - epoch(CAST(day AS TIMESTAMP)), 86400) / 60.0 AS z0, CASE WHEN mins > 1440 THEN 480.0 ELSE 660.0 END AS cap FROM hd
), hc AS (SELECT *, CASE WHEN z0 - a0 > cap AND least(z0, 1140.0) > greatest(a0, 480.0) THEN greatest(a0, 480.0) ELSE a0 END AS a, CASE WHEN z0 - a0 > cap AND least(z0, 1140.0) > greatest(a0, 480.0) THEN least(z0, 1140.0) ELSE z0 END AS z FROM hp
), mt AS (SELECT owner, day, a::DOUBLE AS a, least(z, a + cap)::DOUBLE AS b, block, away, acc, day > CAST(s AS DATE) AS carried FROM hc
), fr AS (
  SELECT owner, s, e, all_day, CASE WHEN all_day THEN CASE WHEN half THEN 0.5 ELSE 1.0 END WHEN e > s THEN
    CASE WHEN busy = 3 THEN CASE WHEN half OR mins <= 300 THEN 0.5 ELSE 1.0 END WHEN mins >= 360 THEN CASE WHEN half THEN 0.5 ELSE 1.0 END WHEN mins >= 180 THEN 0.5 END END AS frac
  FROM judged WHERE leave AND NOT (s1 IN (5, 7) OR r1 IN (4, 5) OR (s1 = 3 AND coalesce(busy, -1) <> 3) OR (coalesce(busy, -1) = 0 AND s1 <> 0))
), fl AS (SELECT *, CASE WHEN e = date_trunc('day', e) AND CAST(e AS DATE) > CAST(s AS DATE) THEN CAST(e AS DATE) - 1 ELSE CAST(e AS DATE) END AS last FROM fr WHERE frac IS NOT NULL
), ab AS (SELECT owner, day, max(frac)::DOUBLE AS absent FROM (SELECT owner, frac, CAST(UNNEST(generate_series(CAST(s AS DATE), last, INTERVAL 1 DAY)) AS DATE) AS day FROM fl WHERE CAST(s AS DATE) <= last) GROUP BY 1, 2
), lv AS (SELECT owner, day, greatest(epoch(s) - epoch(CAST(day AS TIMESTAMP)), 0) / 60.0 AS a, least(epoch(e) - epoch(CAST(day AS TIMESTAMP)), 86400) / 60.0 AS b
  FROM (SELECT owner, s, e, CAST(UNNEST(generate_series(date_trunc('day', s), date_trunc('day', e - to_microseconds(1)), INTERVAL 1 DAY)) AS DATE) AS day FROM fr WHERE frac < 1 AND NOT all_day AND e > s)
), ol AS (
  SELECT *, CASE WHEN e = date_trunc('day', e) AND CAST(e AS DATE) > CAST(s AS DATE) THEN CAST(e AS DATE) - 1 ELSE CAST(e AS DATE) END AS last FROM judged
  WHERE (all_day OR (mins >= 360 AND block)) AND NOT leave AND NOT skip AND NOT (s1 = 3 AND b2 NOT IN (3, 4) AND r1 NOT IN (1, 3)) AND (b2 IN (3, 4) OR (b2 = 2 AND away))
), ofs AS (SELECT DISTINCT owner, day FROM (SELECT *, CAST(UNNEST(generate_series(CAST(s AS DATE), last, INTERVAL 1 DAY)) AS DATE) AS day FROM ol WHERE CAST(s AS DATE) <= last) WHERE all_day OR day = CAST(s AS DATE) OR day < CAST(e AS DATE) OR hour(e) * 60 + minute(e) >= 360
), mh AS (SELECT user_id AS owner, CAST(ts AS DATE) AS day, least(24.0, sum(event_id % 23 / 2.0 - 5))::DOUBLE AS manual_h FROM events WHERE event_type = 'view' AND event_id % 23 > 10 GROUP BY 1, 2
), pt AS (SELECT user_id AS owner, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS m, event_type IN ('purchase', 'signup', 'click') AS productive, event_type = 'signup' AND second(ts) % 2 = 0 AS solver, event_type, second(ts) AS sec FROM events
), mu AS (SELECT owner, day, greatest(min(m) - 60, 0)::DOUBLE AS a, least(max(m) + 60, 1440)::DOUBLE AS b, CASE WHEN owner % 10 = 7 THEN 6 ELSE (owner + day(day)) % 6 END AS k FROM pt GROUP BY owner, day
), mv AS (SELECT owner, day, k, CASE WHEN k = 6 THEN 0 ELSE a END AS a, CASE WHEN k = 6 THEN 1440 ELSE b END AS b FROM mu
), md AS (
  SELECT owner, day, CASE WHEN k = 4 THEN 6.5 ELSE (b - a) * w / 60 END AS on_h, CASE WHEN k = 4 THEN 1.0 ELSE (b - a - greatest(0.0, least(b, 1140.0) - greatest(a, 480.0))) * w / 60 END AS night_h, CASE WHEN k <> 4 THEN a END AS first_min, CASE WHEN k <> 4 THEN b END AS last_min
  FROM (SELECT *, CASE WHEN k IN (2, 3) THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS w FROM mv) WHERE k <> 5
), mc AS (SELECT owner, day, a, b, k IN (0, 1, 6) AS measured FROM mv WHERE k IN (0, 1, 2, 3, 6)
), sv AS (SELECT owner, DATE '1970-01-01' + CAST(date AS INTEGER) AS day, a - date * 1440 AS a, b - date * 1440 AS b FROM credit
), tr AS (
  SELECT owner, day, 'act' AS kind, m::DOUBLE AS a, least(1440.0, m + sec % 7 * 10 + 20)::DOUBLE AS b FROM pt WHERE event_type = 'click'
  UNION ALL SELECT owner, day, 'meet', a, b FROM mt WHERE NOT block
  UNION ALL SELECT owner, day, CASE WHEN b - a >= 360 AND a <= 720 AND b >= 780 THEN 'blkl' ELSE 'blk' END, a, b FROM mt WHERE block AND away
  UNION ALL SELECT owner, day, 'touch', m - 5.0, m + 5.0 FROM pt WHERE NOT solver OR m BETWEEN 480 AND 1139
), kn AS (
  SELECT owner, day FROM capped UNION SELECT owner, day FROM mt UNION SELECT owner, day FROM pt UNION SELECT owner, day FROM ab UNION SELECT owner, day FROM lv UNION SELECT owner, day FROM ofs UNION SELECT owner, day FROM mh UNION SELECT owner, day FROM sv
), s1 AS (SELECT * FROM tr UNION ALL SELECT owner, day, 'win', a, b FROM mc UNION ALL SELECT owner, day, 'lunch', 720, 780 FROM kn
), {_tiles('s1', ['act', 'meet', 'blk', 'blkl', 'touch', 'win', 'lunch'], 't1')}, t1b AS (
  SELECT *, blk_ OR (blkl_ AND NOT (lunch_ AND NOT (touch_ OR meet_ OR act_))) AS block FROM t1
), t1c AS (SELECT *, touch_ OR meet_ OR act_ OR block AS trace, min(a) FILTER (win_) OVER q AS w0, max(b) FILTER (win_) OVER q AS w1 FROM t1b WINDOW q AS (PARTITION BY owner, day)
), shape AS (
  SELECT owner, day, any_value(w0) AS w0, any_value(w1) AS w1, bool_or(trace AND b > w0 AND a < w0 + 10) AS near0, bool_or(trace AND b > w1 - 10 AND a < w1) AS near1, bool_or(block) AS has_block, bool_or(act_) AS has_act, coalesce(sum(b - a) FILTER (act_), 0) AS act_min,
    min(a) FILTER (meet_ OR block) AS m0, max(b) FILTER (meet_ OR block) AS m1, min(a) FILTER (meet_ OR act_ OR block) AS t0, max(b) FILTER (meet_ OR act_ OR block) AS t1 FROM t1c GROUP BY owner, day
), pf AS (
  SELECT owner, day, min(m) FILTER (p) AS prod_min, max(m) FILTER (p) AS prod_max, max(m) FILTER (p AND m >= 1140) AS ev_last, min(m) FILTER (p AND m < 480) AS ev_first, bool_or(solver) AS has_solver
  FROM (SELECT *, productive AND (NOT solver OR m BETWEEN 480 AND 1139) AS p FROM pt) GROUP BY owner, day
), sa AS (SELECT owner, day, bool_or(acc) AS accepted, bool_or(carried) AS carried FROM mt WHERE NOT block GROUP BY owner, day
), f0 AS (
  SELECT owner, day, w0, w1, coalesce(near0, false) AS near0, coalesce(near1, false) AS near1, coalesce(has_block, false) AS has_block, coalesce(has_act, false) AS has_act, coalesce(act_min, 0) AS act_min, m0, m1, t0, t1, prod_min, prod_max, ev_last, ev_first,
    coalesce(has_solver, false) AS has_solver, coalesce(accepted, false) AS accepted, coalesce(carried, false) AS carried, coalesce(mm.measured, false) AS measured, coalesce(on_h, 0.0) AS on_h, coalesce(night_h, 0.0) AS night_h, first_min, last_min, coalesce(absent, 0.0) AS absent,
    ofs.owner IS NOT NULL AND coalesce(absent, 0.0) < 1 AS is_offsite, coalesce(manual_h, 0.0) AS manual_h, isodow(day) > 5 AS off
  FROM kn LEFT JOIN shape USING (owner, day) LEFT JOIN pf USING (owner, day) LEFT JOIN sa USING (owner, day) LEFT JOIN (SELECT owner, day, measured FROM mc) mm USING (owner, day) LEFT JOIN md USING (owner, day) LEFT JOIN ab USING (owner, day) LEFT JOIN ofs USING (owner, day) LEFT JOIN mh USING (owner, day)
), f1 AS (
  SELECT f0.*, coalesce(f0.night_h > 0 AND n.night_h > 0 AND f0.last_min >= 1440 AND n.first_min <= 0 AND f0.ev_last IS NOT NULL AND n.ev_first IS NOT NULL, false) AS onward,
    coalesce(f0.night_h > 0 AND v.night_h > 0 AND v.last_min >= 1440 AND f0.first_min <= 0 AND v.ev_last IS NOT NULL AND f0.ev_first IS NOT NULL, false) AS back,
    coalesce(f0.on_h >= 20 OR (f0.first_min <= 0 AND f0.last_min >= 1440), false) AS always,
    f0.prod_min IS NOT NULL OR f0.has_solver OR f0.accepted OR f0.has_act OR f0.has_block OR f0.is_offsite OR f0.manual_h > 0 AS active
  FROM f0 LEFT JOIN f0 n ON n.owner = f0.owner AND n.day = f0.day + 1 LEFT JOIN f0 v ON v.owner = f0.owner AND v.day = f0.day - 1
), f2 AS (SELECT * REPLACE (CASE WHEN NOT always AND w0 > 0 AND NOT near0 THEN w0 + 10 ELSE w0 END AS w0, CASE WHEN NOT always AND w1 < 1440 AND NOT near1 THEN w1 - 10 ELSE w1 END AS w1) FROM f1
), wn AS (SELECT mc.owner, mc.day, greatest(a, w0) AS a, least(b, w1) AS b FROM mc JOIN f2 USING (owner, day) WHERE least(b, w1) > greatest(a, w0)
), we AS (SELECT owner, day, min(a) AS first_on, max(b) AS last_on FROM wn GROUP BY owner, day
), f3 AS (SELECT f2.*, first_on IS NOT NULL AS has_win, coalesce(first_on, first_min) AS t_first, coalesce(last_on, last_min) AS t_last FROM f2 LEFT JOIN we USING (owner, day)
), f4 AS (
  SELECT *, NOT off AND night_h > 0 AND prod_min IS NOT NULL AND t_last IS NOT NULL AS credits, off AND prod_min IS NOT NULL AND on_h > 0 AND t_first IS NOT NULL AND t_last IS NOT NULL AND NOT has_act AS wide FROM f3
), facts AS (
  SELECT *, CASE WHEN credits AND ev_last IS NOT NULL THEN greatest(1140.0, coalesce(t_first, 1140.0)) END AS ea, CASE WHEN credits AND ev_last IS NOT NULL THEN least(t_last, CASE WHEN onward THEN 1440.0 ELSE ev_last + 30.0 END) END AS eb,
    CASE WHEN credits AND ev_first IS NOT NULL AND t_first IS NOT NULL THEN greatest(t_first, CASE WHEN back THEN 0.0 ELSE ev_first - 30.0 END) END AS da, CASE WHEN credits AND ev_first IS NOT NULL AND t_first IS NOT NULL THEN least(480.0, t_last) END AS db
  FROM f4
), s2 AS (
  SELECT owner, day, kind, greatest(a, 0.0) AS a, least(b, 1440.0) AS b FROM (
    SELECT * FROM tr UNION ALL SELECT owner, day, 'sess', a, b FROM capped UNION ALL SELECT owner, day, 'cov', greatest(m - 30.0, 0), least(m + 120.0, 1440) FROM pt WHERE event_type = 'click' UNION ALL SELECT owner, day, 'win', a, b FROM wn UNION ALL SELECT owner, day, 'leave', a, b FROM lv
    UNION ALL SELECT owner, day, 'solver', a, b FROM sv UNION ALL SELECT owner, day, 'weekend', CASE WHEN back THEN t_first ELSE greatest(t_first, prod_min - 30.0) END, CASE WHEN onward THEN t_last ELSE least(t_last, prod_max + 30.0) END FROM facts WHERE wide
    UNION ALL SELECT owner, day, 'eve', ea, eb FROM facts UNION ALL SELECT owner, day, 'dawn', da, db FROM facts
    UNION ALL SELECT owner, day, 'tw', greatest(0.0, least(prod_min, t0) - 30.0), least(1440.0, greatest(prod_max, t1) + 30.0) FROM facts WHERE coalesce(prod_min, t0) IS NOT NULL
    UNION ALL SELECT owner, day, 'tm', greatest(0.0, least(prod_min, m0) - 30.0), least(1440.0, greatest(prod_max, m1) + 30.0) FROM facts WHERE coalesce(prod_min, m0) IS NOT NULL
    UNION ALL SELECT owner, day, unnest(['dayw', 'lunch', 'dinner', 'flex', 'whole']), unnest([480.0, 720.0, 1080.0, 420.0, 0.0]), unnest([1140.0, 780.0, 1110.0, 1200.0, 1440.0]) FROM facts
  ) WHERE a IS NOT NULL AND b IS NOT NULL AND least(b, 1440.0) > greatest(a, 0.0)
), {_tiles('s2', ['act', 'meet', 'sess', 'blk', 'blkl', 'cov', 'touch', 'win', 'leave', 'solver', 'weekend', 'eve', 'dawn', 'tw', 'tm', 'dayw', 'lunch', 'dinner', 'flex'], 't2')}, p0 AS (
  SELECT t2.*, facts.* EXCLUDE (owner, day), blk_ OR (blkl_ AND NOT (lunch_ AND NOT (touch_ OR meet_ OR act_))) AS block FROM t2 JOIN facts USING (owner, day)
), p1 AS (SELECT *, touch_ OR meet_ OR act_ OR block AS trace, CASE WHEN off AND NOT active THEN meet_ AND carried ELSE act_ OR meet_ OR sess_ OR block END AS base, {_sum('weekend_ AND lunch_', 'wl')} FROM p0 WINDOW q AS (PARTITION BY owner, day)
), p2 AS (SELECT *, weekend_ AND NOT (lunch_ AND NOT trace AND wl >= 30) AS wd FROM p1
), p3 AS (SELECT *, {_sum('base', 'base_min')}, {_sum('wd AND NOT base', 'wide_min')} FROM p2 WINDOW q AS (PARTITION BY owner, day)
), p4 AS (SELECT *, base OR (wd AND wide_min > 1e-9 AND on_h * 60 > base_min + 1e-9) AS in1 FROM p3
), p5 AS (SELECT *, solver_ AND NOT in1 AS solved, in1 OR solver_ AS in2 FROM p4
), p6 AS (SELECT *, night_h * 60 - {_sum('NOT dayw_ AND in2 AND NOT solved', 'allowed')} FROM p5 WINDOW q AS (PARTITION BY owner, day)
), g0 AS (SELECT owner, day, allowed, b - a AS n, CASE WHEN eve_ THEN (eb - b) / (eb - ea) ELSE (a - da) / (db - da) END AS lo, CASE WHEN eve_ THEN (eb - a) / (eb - ea) ELSE (b - da) / (db - da) END AS hi FROM p6 WHERE (eve_ OR dawn_) AND NOT in2
), g1 AS (SELECT DISTINCT owner, day, allowed, unnest([0.0::DOUBLE, 1.0::DOUBLE, lo, hi]) AS x FROM g0
), g2 AS (SELECT g1.owner, g1.day, g1.allowed, x, sum(n * greatest(0.0, least(1.0, (x - lo) / (hi - lo)))) AS added FROM g1 JOIN g0 USING (owner, day) GROUP BY ALL
), g3 AS (SELECT *, lead(x) OVER q AS x2, lead(added) OVER q AS added2 FROM g2 WINDOW q AS (PARTITION BY owner, day ORDER BY x)
), g4 AS (SELECT owner, day, CASE WHEN any_value(allowed) <= 1e-9 THEN 0.0 ELSE coalesce(max(x + (allowed - added) * (x2 - x) / (added2 - added)) FILTER (added <= allowed + 1e-9 AND added2 > allowed + 1e-9), 1.0) END AS share FROM g3 GROUP BY owner, day
), p7 AS (SELECT p6.*, CASE WHEN eve_ THEN eb - (eb - ea) * coalesce(share, 0) WHEN dawn_ THEN da + (db - da) * coalesce(share, 0) END AS cut FROM p6 LEFT JOIN g4 USING (owner, day)
), p8 AS (
  SELECT * REPLACE (CASE WHEN side = 2 THEN cut ELSE a END AS a, CASE WHEN side = 1 THEN cut ELSE b END AS b) FROM (SELECT *, unnest(CASE WHEN cut > a + 1e-9 AND cut < b - 1e-9 THEN [1, 2] ELSE [0] END) AS side FROM p7)
), p9 AS (SELECT *, in2 OR coalesce((eve_ AND a >= cut - 1e-9) OR (dawn_ AND b <= cut + 1e-9), false) AS in3 FROM p8
), q0 AS (SELECT *, CASE WHEN in3 = lag(in3) OVER w THEN 0 ELSE 1 END AS turned, min(a) FILTER (in3) OVER q AS first_in, max(b) FILTER (in3) OVER q AS last_in FROM p9 WINDOW w AS (PARTITION BY owner, day ORDER BY a), q AS (PARTITION BY owner, day)
), q1 AS (SELECT *, sum(turned) OVER (PARTITION BY owner, day ORDER BY a) AS run, lunch_ OR (dinner_ AND (night_h > 0 OR coalesce(t_last >= 1110, false) OR coalesce(last_in >= 1110, false))) AS meal FROM q0
), q2 AS (SELECT *, {_sum('true', 'gap_min')}, {_sum('cov_', 'gap_cov')}, {_sum('NOT meal', 'gap_work')} FROM q1 WINDOW q AS (PARTITION BY owner, day, run)
), q3 AS (
  SELECT *, in3 OR coalesce(has_act AND NOT off AND NOT in3 AND a >= first_in AND b <= last_in AND gap_cov >= gap_min - 1e-6 AND gap_work > 1e-9 AND gap_work <= 60 + 1e-9 AND NOT meal, false) AS in4,
    least(11.0, greatest(0.0, on_h - night_h)) AS on_day FROM q2
), q4 AS (SELECT *, CASE WHEN measured THEN 'spans' WHEN on_day > 0 AND has_win THEN 'window' WHEN on_day > 0 THEN 'hours' END AS clock FROM q3
), q5 AS (SELECT *, CASE WHEN clock = 'hours' THEN dayw_ WHEN clock IS NOT NULL THEN win_ AND dayw_ ELSE false END AS own FROM q4
), q6 AS (SELECT *, {_sum('own', 'own_min')} FROM q5 WINDOW q AS (PARTITION BY owner, day)
), q7 AS (SELECT *, own AND (NOT (always AND own_min > 0) OR tw_) AS kept FROM q6
), q8 AS (SELECT *, {_sum('kept', 'kept_min')} FROM q7 WINDOW q AS (PARTITION BY owner, day)
), q9 AS (SELECT *, kept_min <= 0 AND NOT has_act AND NOT is_offsite AND manual_h <= 0 AND (prod_min IS NOT NULL OR accepted OR has_block) AS bare FROM q8
), r0 AS (SELECT *, CASE WHEN bare THEN 'trace' WHEN always AND own_min > 0 THEN 'always_on' ELSE clock END AS basis, CASE WHEN bare THEN tm_ AND dayw_ ELSE kept END AS ground FROM q9
), r1 AS (SELECT *, ground AND NOT leave_ AS left_ FROM r0
), r2 AS (SELECT *, {_sum('ground', 'ground_min')}, {_sum('left_', 'left_min')}, {_sum('left_ AND lunch_', 'left_lunch')} FROM r1 WINDOW q AS (PARTITION BY owner, day)
), r3 AS (SELECT *, CASE WHEN basis IN ('window', 'hours') THEN on_day ELSE ground_min / 60 END AS hours_on, left_ AND NOT (has_act AND cov_) AS unc FROM r2
), r4 AS (
  SELECT *, unc AND lunch_ AND NOT trace AND left_lunch >= 30 AND (basis <> 'window' OR left_lunch / 60 <= hours_on + 1e-9) AS noon, unc AND dinner_ AND NOT trace AND night_h > 0 AND hours_on >= 6 AND coalesce(last_min >= 1110, false) AS eats FROM r3
), r5 AS (
  SELECT owner, day, coalesce(sum(b - a) FILTER (in4 AND dayw_), 0) AS day_min, coalesce(sum(b - a) FILTER (in4 AND NOT dayw_), 0) AS night_min, coalesce(sum(b - a) FILTER (in4 AND NOT dayw_ AND NOT solved), 0) AS night_ex, coalesce(sum(b - a) FILTER (unc AND NOT noon AND NOT eats), 0) AS floor_raw,
    coalesce(sum(b - a) FILTER (noon), 0) AS lunch_min, coalesce(sum(b - a) FILTER (eats), 0) AS dinner_min, coalesce(sum(b - a) FILTER (unc AND (meet_ OR block)), 0) AS met_min, coalesce(sum(b - a) FILTER (in4 AND dayw_ AND unc), 0) AS inside_min,
    coalesce(sum(b - a) FILTER (win_ AND flex_ AND NOT dayw_ AND NOT in4), 0) AS flex_min, coalesce(sum(b - a) FILTER (in1 AND NOT base), 0) AS wide_add, coalesce(sum(b - a) FILTER (solved), 0) AS solver_min, coalesce(sum(b - a) FILTER (in3 AND NOT in2), 0) AS credit_min,
    coalesce(sum(b - a) FILTER (in4 AND NOT in3), 0) AS bridge_min, any_value(off) AS off, any_value(absent) AS absent, any_value(on_h) AS on_h, any_value(night_h) AS night_h, any_value(on_day) AS on_day, any_value(basis) AS basis, any_value(active) AS active, any_value(is_offsite) AS is_offsite,
    any_value(manual_h) AS manual_h, any_value(act_min) AS act_min, any_value(ground_min) AS ground_min, any_value(left_min) AS left_min, any_value(has_win) AS has_win FROM r4 GROUP BY owner, day
), r6 AS (
  SELECT *, NOT off AND absent < 1 AND day_min + night_ex > 0 AND active AS gate, day_min - inside_min AS rest,
    CASE basis WHEN 'window' THEN greatest(0.0, floor_raw / 60 - greatest(0.0, greatest(0.0, ground_min / 60 - on_day) * CASE WHEN ground_min > 0 THEN left_min / ground_min ELSE 1 END - lunch_min / 60 - met_min / 60))
      WHEN 'hours' THEN greatest(0.0, least(floor_raw / 60, on_day - lunch_min / 60 - dinner_min / 60 + met_min / 60)) WHEN 'trace' THEN least(floor_raw / 60, 8.0) ELSE floor_raw / 60 END AS fh FROM r5
), r7 AS (SELECT *, CASE WHEN absent > 0 AND absent < 1 THEN least(fh, greatest(0.0, 8 * (1 - absent) - rest / 60)) ELSE fh END AS held FROM r6
), r8 AS (
  SELECT *, CASE WHEN gate AND basis IS NOT NULL AND left_min > 0 AND held * 60 > inside_min + 1e-9 THEN held * 60 - inside_min ELSE 0 END AS floor_add,
    CASE WHEN gate AND basis IN ('window', 'spans') AND has_win AND NOT off AND night_h * 60 - night_ex > 1e-9 THEN least(flex_min, night_h * 60 - night_ex) ELSE 0 END AS flex_add FROM r7
), r9 AS (SELECT *, (day_min + floor_add + night_min + flex_add) / 60 AS traced_h FROM r8
), final AS (SELECT *, greatest(traced_h, CASE WHEN is_offsite AND NOT off THEN 8 * (1 - absent) ELSE 0 END, manual_h) AS worked FROM r9
), whole AS (
  SELECT owner, day, {_X.format(x='least(worked, 24.0)')} AS hours, {_X.format(x='(day_min + floor_add) / 60')} AS day_h, {_X.format(x='(night_min + flex_add) / 60')} AS night_h, {_X.format(x='wide_add / 60')} AS weekend_h, {_X.format(x='solver_min / 60')} AS solver_h,
    {_X.format(x='credit_min / 60')} AS credit_h, {_X.format(x='bridge_min / 60')} AS bridge_h, {_X.format(x='floor_add / 60')} AS floor_h, {_X.format(x='flex_add / 60')} AS flex_h, {_X.format(x='worked - traced_h')} AS least_h, CASE WHEN gate AND left_min > 0 THEN basis END AS basis, active,
    least(worked, 24.0) > 16 AS long_day, concat_ws('; ', CASE WHEN on_h - night_h > 11 + 1e-9 THEN 'machine day over 11 h' END, CASE WHEN act_min >= 1200 THEN 'sampler active for 20 h or more' END, CASE WHEN absent >= 1 AND worked > 0 THEN 'work on a day of absence' END, CASE WHEN worked > 24 THEN 'more than 24 h' END) AS anomalies
  FROM final)"""

ORACLE_SQL = {
    "whole_day_hours": f"{_WHOLE_DAYS} SELECT * FROM whole",
    "day_anomalies": f"{_WHOLE_DAYS} SELECT owner, unnest(string_split(anomalies, '; ')) AS kind, count(*) AS days, round(sum(hours), 2)::DOUBLE AS hours FROM whole WHERE anomalies <> '' GROUP BY 1, 2",
    "solver_night_credit": f"""WITH {_NIGHT_ROWS}
SELECT owner, DATE '1970-01-01' + CAST(date AS INTEGER) AS day, sum(b - a)::DOUBLE AS minutes, count(DISTINCT night) AS nights, bool_or(opened) AS opened, bool_or(capped) AS capped, min(a - date * 1440)::DOUBLE AS start FROM credit GROUP BY owner, date""",
    "sampler_spans": """WITH o AS (
  SELECT user_id % 3 AS owner, CAST(ts AS DATE) AS day, (hour(ts) * 60 + minute(ts))::DOUBLE AS m, min((CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id * 7 % 500 END, CASE WHEN event_id % 5 < 4 THEN 'doc' ELSE event_type END)) AS s FROM events GROUP BY 1, 2, 3
), x AS (SELECT owner, day, m, s[1] AS idle, s[2] AS title FROM o
), c AS (SELECT *, CASE WHEN title = lag(title) OVER w THEN 0 ELSE 1 END AS ch FROM x WINDOW w AS (PARTITION BY owner, day ORDER BY m)
), r AS (SELECT *, sum(ch) OVER (PARTITION BY owner, day ORDER BY m) AS run FROM c
), act AS (SELECT *, least(1440.0, m + 5) AS e, lag(least(1440.0, m + 5)) OVER (PARTITION BY owner, day, run ORDER BY m) AS p FROM r WHERE idle <= 300
), allspans AS (
  SELECT owner, day, 'active' AS kind, CASE WHEN m - p BETWEEN 0 AND 10 THEN p ELSE m END AS a, e AS b FROM act UNION ALL SELECT owner, day, 'cover', m, least(1440.0, m + 15) FROM x
), um AS (SELECT *, max(b) OVER (PARTITION BY owner, day, kind ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM allspans WHERE a < b
), ug AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY owner, day, kind ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM um
), u AS (SELECT owner, day, kind, max(b) - min(a) AS n FROM ug GROUP BY owner, day, kind, g
), d AS (SELECT owner, day, kind, round(sum(n), 2)::DOUBLE AS minutes, count(*) AS spans FROM u GROUP BY 1, 2, 3
), st AS (SELECT x.owner, x.day FROM x JOIN d ON d.owner = x.owner AND d.day = x.day AND d.kind = 'cover' GROUP BY 1, 2 HAVING any_value(d.minutes) >= 840 AND avg((idle > 0)::INT) < 0.02)
SELECT owner, day, kind, minutes, spans FROM d ANTI JOIN st USING (owner, day)""",
    "order_shared_done": """WITH e AS (SELECT user_id AS owner, ts, event_type, event_id % 20 AS w1, event_id % 7 AS w2 FROM events),
p AS (SELECT v.owner, v.ts AS order_at, min(d.ts) AS done_at FROM e v JOIN e d ON d.owner = v.owner AND d.event_type = 'purchase' AND v.event_type = 'view' AND d.ts > v.ts AND epoch_us(d.ts) - epoch_us(v.ts) <= 14 * 86400000000
  AND (v.w1 IN (d.w1, d.w2) OR v.w2 IN (d.w1, d.w2)) GROUP BY 1, 2)
SELECT owner, done_at, max(order_at) AS order_at, round((epoch_us(done_at) - epoch_us(max(order_at))) / 3600e6, 2) AS lead_h FROM p GROUP BY 1, 2""",
    "meeting_spans": f"""WITH {_ENTRIES}, held AS (
  SELECT *, CASE WHEN status IS NULL AND response IS NULL THEN b2 IN (2, 3) ELSE s1 IN (1, 3) OR r1 IN (1, 3) END AS acc FROM judged
  WHERE NOT leave AND NOT skip AND NOT all_day AND e > s AND NOT (training AND b2 NOT IN (2, 3) AND r1 NOT IN (1, 3))
), d AS (SELECT *, CAST(UNNEST(generate_series(date_trunc('day', s), date_trunc('day', e - to_microseconds(1)), INTERVAL 1 DAY)) AS DATE) AS day FROM held
), p AS (SELECT *, greatest(epoch(s) - epoch(CAST(day AS TIMESTAMP)), 0) / 60.0 AS a, least(epoch(e) - epoch(CAST(day AS TIMESTAMP)), 86400) / 60.0 AS z, CASE WHEN mins > 1440 THEN 480.0 ELSE 660.0 END AS cap FROM d
), c AS (SELECT *, CASE WHEN z - a > cap AND least(z, 1140.0) > greatest(a, 480.0) THEN greatest(a, 480.0) ELSE a END AS a2, CASE WHEN z - a > cap AND least(z, 1140.0) > greatest(a, 480.0) THEN least(z, 1140.0) ELSE z END AS z2 FROM p)
SELECT owner, day, block, round(sum(least(z2, a2 + cap) - a2), 2)::DOUBLE AS minutes, count(*) AS pieces, bool_or(acc) AS accepted, bool_or(day > CAST(s AS DATE)) AS carried FROM c GROUP BY owner, day, block""",
    "calendar_absence_days": f"""WITH {_ENTRIES}, f AS (
  SELECT owner, s, e, CASE WHEN all_day THEN CASE WHEN half THEN 0.5 ELSE 1.0 END WHEN e > s THEN
    CASE WHEN busy = 3 THEN CASE WHEN half OR mins <= 300 THEN 0.5 ELSE 1.0 END WHEN mins >= 360 THEN CASE WHEN half THEN 0.5 ELSE 1.0 END WHEN mins >= 180 THEN 0.5 END END AS frac
  FROM judged WHERE leave AND NOT (s1 IN (5, 7) OR r1 IN (4, 5) OR (s1 = 3 AND coalesce(busy, -1) <> 3) OR (coalesce(busy, -1) = 0 AND s1 <> 0))
), l AS (SELECT *, CASE WHEN e = date_trunc('day', e) AND CAST(e AS DATE) > CAST(s AS DATE) THEN CAST(e AS DATE) - 1 ELSE CAST(e AS DATE) END AS last FROM f WHERE frac IS NOT NULL
), x AS (SELECT owner, frac, CAST(UNNEST(generate_series(CAST(s AS DATE), last, INTERVAL 1 DAY)) AS DATE) AS day FROM l WHERE CAST(s AS DATE) <= last)
SELECT owner, day, max(frac)::DOUBLE AS frac FROM x GROUP BY owner, day""",
    "offsite_days": f"""WITH {_ENTRIES}, f AS (
  SELECT *, CASE WHEN e = date_trunc('day', e) AND CAST(e AS DATE) > CAST(s AS DATE) THEN CAST(e AS DATE) - 1 ELSE CAST(e AS DATE) END AS last FROM judged
  WHERE (all_day OR (mins >= 360 AND block)) AND NOT leave AND NOT skip AND NOT (s1 = 3 AND b2 NOT IN (3, 4) AND r1 NOT IN (1, 3)) AND (b2 IN (3, 4) OR (b2 = 2 AND away))
), x AS (SELECT *, CAST(UNNEST(generate_series(CAST(s AS DATE), last, INTERVAL 1 DAY)) AS DATE) AS day FROM f WHERE CAST(s AS DATE) <= last)
SELECT owner, day, arg_min(subject, (s, subject)) AS subject FROM x WHERE all_day OR day = CAST(s AS DATE) OR day < CAST(e AS DATE) OR hour(e) * 60 + minute(e) >= 360 GROUP BY owner, day""",
    "manual_hours": """WITH w AS (SELECT DISTINCT user_id AS owner, CAST(ts AS DATE) AS day, event_type, (event_id % 60 - 5) / 2.0::DOUBLE AS hours FROM events)
SELECT owner, day, least(24.0, sum(hours))::DOUBLE AS hours, count(*) AS entries FROM w WHERE hours > 0 AND hours <= 24 GROUP BY owner, day""",
    "daily_from_spans": f"WITH {_MACHINE}, {_union('mspan')} SELECT owner, day, on_h::DOUBLE AS on_h, night_h::DOUBLE AS night_h, first_min::DOUBLE AS first_min, last_min::DOUBLE AS last_min, isodow(day) > 5 AS weekend FROM u",
    "merged_machine_days": f"""WITH {_MACHINE}, own AS (SELECT * FROM mspan WHERE root = 0), other AS (SELECT * FROM mspan WHERE root > 0),
a AS (WITH {_union('own')} SELECT * FROM u), b AS (WITH {_union('other')} SELECT * FROM u),
m AS (SELECT coalesce(a.owner, b.owner) AS owner, coalesce(a.day, b.day) AS day, CASE WHEN a.on_h IS NULL OR b.on_h > a.on_h THEN b ELSE a END AS r FROM a FULL JOIN b ON a.owner = b.owner AND a.day = b.day)
SELECT owner, day, r.on_h::DOUBLE AS on_h, r.night_h::DOUBLE AS night_h, r.first_min::DOUBLE AS first_min, r.last_min::DOUBLE AS last_min, isodow(day) > 5 AS weekend FROM m""",
    "power_days": f"""WITH {_MACHINE}, r0 AS (
  SELECT user_id AS owner, event_id % 3 AS root, CAST(ts AS DATE) AS day, least(greatest(CASE WHEN event_id % 2 = 0 THEN event_id % 500 / 60.0::DOUBLE ELSE (event_id % 270 - 10) / 10.0::DOUBLE END, 0.0), 24.0) AS on_h,
    event_id % 30 / 10.0::DOUBLE AS ni, event_id * 7 % 900 AS f0, event_id * 7 % 900 + event_id % 500 - CASE WHEN event_id % 17 = 0 THEN 600 ELSE 0 END AS l0 FROM events WHERE event_type IN ('purchase', 'view')
), r AS (SELECT owner, root, day, on_h, least(ni, on_h) AS ni, CASE WHEN f0 <= l0 THEN f0 END AS f, CASE WHEN f0 <= l0 THEN l0 END AS l FROM r0
), rec AS (SELECT owner, day, max(on_h - ni) AS d, max(ni) AS n, min(f) AS f, max(l) AS l FROM r GROUP BY owner, day
), have AS (SELECT DISTINCT owner, root, day FROM mspan WHERE a < b
), both_ AS (SELECT owner, day, a, b FROM mspan UNION ALL SELECT owner, day, f, l FROM r ANTI JOIN have USING (owner, root, day) WHERE l > f AND abs(l - f - on_h * 60) <= 15
), {_union('both_')}, k AS (SELECT owner, day, count(DISTINCT root) AS roots FROM (SELECT * FROM have UNION ALL SELECT owner, root, day FROM r) GROUP BY owner, day),
j AS (SELECT k.owner, k.day, roots < 2 AND rec.d IS NOT NULL AS alone, rec.d, rec.n, rec.f, rec.l, u.on_h - u.night_h AS ud, u.night_h AS un, u.first_min AS uf, u.last_min AS ul FROM k LEFT JOIN rec ON rec.owner = k.owner AND rec.day = k.day LEFT JOIN u ON u.owner = k.owner AND u.day = k.day),
w AS (SELECT *, CASE WHEN alone THEN d ELSE greatest(d, ud) END AS dd, CASE WHEN alone THEN n ELSE greatest(n, un) END AS nn FROM j)
SELECT owner, day, round(least(24.0, dd + nn), 2)::DOUBLE AS on_h, round(nn, 2)::DOUBLE AS night_h, (CASE WHEN alone THEN f ELSE least(f, uf) END)::DOUBLE AS first_min, (CASE WHEN alone THEN l ELSE greatest(l, ul) END)::DOUBLE AS last_min FROM w""",
}
