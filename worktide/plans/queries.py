"""The registered queries: each applies operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from worktide.functions import predicates as P, text as T
from worktide.functions.config import Settings
from worktide.operators import allocation, board, hours, intervals, pivots, resolve, sampling, sessions, signals, team

S = Settings()


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(spark, sf) -> DataFrame:
    return signals.signals_of_events(t(spark, sf, "events"), S)


def period(spark, sf) -> tuple[str, str]:
    """The first and the last day of the calendar months that the events touch;
    without events any one day serves."""
    ends = t(spark, sf, "events").agg(F.trunc(F.min("ts"), "MM").cast("string"), F.last_day(F.max("ts")).cast("string")).first()
    return tuple(x or "2024-01-01" for x in ends)


def lone(spark, sf) -> DataFrame:
    """Each signal as a span of its label's width, clipped to the day."""
    half = F.greatest(F.lit(2.5), F.col("width") / 2)
    spans = sig(spark, sf).withColumns({"a": F.col("minute") - half, "b": F.col("minute") + half})
    return intervals.clip(spans, F.lit(0.0), F.lit(1440.0))


# -- signals and allocation


def signal_weighted_grid(spark, sf):
    return allocation.grid(sig(spark, sf), ["owner", "source"])


def confidence_grade(spark, sf):
    cells = allocation.grid(sig(spark, sf), ["owner"])
    return cells.select("owner", "families", "days", allocation.confidence(F.col("families"), F.col("days")).alias("confidence"))


def share_allocation(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cells = rows.groupBy(F.col("l_suppkey").alias("owner"), F.col("p_brand").alias("project")).agg(F.sum("l_quantity").alias("weight"))
    return allocation.allocate(cells, ["owner"], ["project"], F.lit(3.0)).select("owner", "project", "weight", "share", "mm")


def strongest_signal(spark, sf):
    """One signal an owner, day and source: the heaviest, then the earliest."""
    keys = ["owner", "day", "event_type"]
    rows = t(spark, sf, "events").select(F.col("user_id").alias("owner"), F.to_date("ts").alias("day"), "event_type", "value", "event_id")
    best = signals.strongest_of_key(rows, keys, "value", "event_id")
    return best.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


def mm_rescale(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("owner"), F.col("l_returnflag").alias("project")).agg(F.sum("l_quantity").alias("mm"))
    official = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("owner"), F.col("s_acctbal").alias("official"))
    out = allocation.rescale(rows.join(official, "owner"), "owner", "mm", F.col("official"))
    return out.select("owner", "project", "mm", F.round("factor", 6).alias("factor"), F.round("scaled", 3).alias("scaled"))


def prorata_allocation(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("owner"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("project")).agg(F.sum("l_quantity").alias("mm"))
    out = allocation.prorata(rows, "owner", "mm", F.col("project") == "N")
    return out.select("owner", "status", "project", "mm", F.round("spread", 3).alias("spread"))


def coverage_grade(spark, sf):
    days = sig(spark, sf).groupBy("owner").agg(F.count_distinct("day").alias("days"), F.count_distinct("source").alias("sources"), F.max(F.when(F.col("source") == "purchase", 1).otherwise(0)).alias("bought"))
    grade = allocation.coverage_grade(F.col("days") < 20, F.col("sources") < 5, F.col("bought") == 0)
    return days.select("owner", "days", "sources", grade.alias("grade"))


def rehours_difference(spark, sf):
    """Hours a day with and without the weak signals."""
    all_spans, strong = lone(spark, sf), lone(spark, sf).where("active")
    before, after = (intervals.union_hours(x).groupBy("owner").agg(F.round(F.sum("hours"), 2).alias("h")) for x in (all_spans, strong))
    return allocation.remeasured(before, after, ["owner"], "h")


# -- intervals


def interval_union_hours(spark, sf):
    return intervals.union_hours(lone(spark, sf))


def interval_intersect_minutes(spark, sf):
    spans = lone(spark, sf)
    both = intervals.intersect(spans.where("source = 'purchase'"), spans.where("source = 'signup'"))
    return both.groupBy("owner", "day").agg(F.round(F.sum(F.col("b") - F.col("a")), 2).alias("minutes"), F.count(F.lit(1)).alias("pieces"))


def interval_subtract_minutes(spark, sf):
    spans = lone(spark, sf)
    rest = intervals.subtract(spans.where("source = 'purchase'"), spans.where("source = 'signup'"))
    return rest.groupBy("owner", "day").agg(F.round(F.sum(F.col("b") - F.col("a")), 2).alias("minutes"), F.count(F.lit(1)).alias("pieces"))


def interval_clip_day(spark, sf):
    inside = intervals.clip(lone(spark, sf), F.lit(float(S.day_window[0])), F.lit(float(S.day_window[1])))
    return intervals.union_hours(inside)


def interval_tail(spark, sf):
    tail = intervals.last_minutes(intervals.union(lone(spark, sf)), 60.0)
    return tail.groupBy("owner", "day").agg(F.round(F.sum(F.col("b") - F.col("a")), 2).alias("minutes"), F.round(F.min("a"), 2).alias("starts"))


def fit_credit(spark, sf):
    """Evening spans cut to one share so that they stay within two hours a day."""
    evening = intervals.clip(intervals.union(lone(spark, sf)), F.lit(float(S.day_window[1])), F.lit(1440.0)).withColumn("anchor", F.lit("a"))
    fit = intervals.scale_to_fit(evening, "anchor", F.lit(120.0))
    return fit.groupBy("owner", "day").agg(F.round(F.sum(F.col("b") - F.col("a")), 2).alias("minutes"))


def day_night_split(spark, sf):
    out = hours.split_day_night(lone(spark, sf).select("owner", "day", "a", "b"), S)
    return out.select("owner", "day", F.round("day_min", 2).alias("day_min"), F.round("night_min", 2).alias("night_min"))


def midnight_split(spark, sf):
    spans = t(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "ts", (F.col("ts") + F.expr("INTERVAL 30 HOURS")).alias("until"))
    cut = intervals.midnight_split(spans, "ts", "until")
    return cut.groupBy("day").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(F.col("b") - F.col("a")), 1).alias("minutes"))


def trace_window(spark, sf):
    return intervals.trace_window(sig(spark, sf).withColumn("minute", F.col("minute").cast("double")), "minute", S.night_pad_min)


def edge_trim(spark, sf):
    points = sig(spark, sf).withColumn("minute", F.col("minute").cast("double"))
    windows = points.select("owner", "day").distinct().select("owner", "day", F.lit(480.0).alias("a"), F.lit(1140.0).alias("b"))
    return intervals.trim_edges(windows, points, "minute", S.trim_edges_min)


def minute_clusters(spark, sf):
    """Runs of active hours (the events are sparse) across all owners."""
    points = sig(spark, sf).select("source", "day", F.hour("ts").alias("hour"))
    return intervals.minute_clusters(points, "hour", ["source", "day"], 2)


def burst_minutes(spark, sf):
    points = sig(spark, sf).select("source", "day", F.hour("ts").alias("hour"))
    return intervals.bursts(points, "hour", ["source", "day"], S.burst_n)


# -- sessions and pairing


def session_gap_30(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("owner"), "ts")
    out = sessions.visit_sessions(rows, ["owner"], "ts", S.visit_gap_min, S.visit_tail_min)
    return out.groupBy("owner").agg(F.count(F.lit(1)).alias("visits"), F.sum("points").alias("points"), F.sum(F.timestamp_diff("SECOND", "start", "end")).alias("seconds"))


def session_active_passive(spark, sf):
    return sessions.signal_sessions(sig(spark, sf), S)


def passive_cap(spark, sf):
    spans = lone(spark, sf).where("not active").select("owner", F.trunc("day", "MM").alias("day"), (F.dayofmonth("day") * 1440 + F.col("a")).alias("a"), (F.dayofmonth("day") * 1440 + F.col("b")).alias("b"), "active")
    capped = sessions.cap_passive(intervals.union(spans, ["owner", "day"]).withColumn("active", F.lit(False)), S.passive_day_max_min)
    return capped.groupBy("owner", "day").agg(F.round(F.sum(F.col("b") - F.col("a")), 2).alias("minutes"), F.count(F.lit(1)).alias("spans"))


def asof_reply(spark, sf):
    turns = t(spark, sf, "conversations")
    paired = sessions.next_matching(turns, ["conv_id"], ["turn"], F.col("role") == "assistant", F.col("turn"), "reply_turn")
    return paired.where("role = 'user'").select("conv_id", "turn", "reply_turn")


def order_done_lead(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("owner"), "ts", "event_type")
    return sessions.order_to_done(rows, ["owner"], "ts", F.col("event_type") == "view", F.col("event_type") == "purchase", S.order_done_days)


def episode_spans(spark, sf):
    rows = t(spark, sf, "events").where("event_type = 'signup'").select(F.col("user_id").alias("owner"), F.to_date("ts").alias("day"))
    return sessions.episodes(rows, ["owner"], "day", S.episode_gap_days)


def evidence_gaps(spark, sf):
    """Runs of three or more workdays without a purchase."""
    rows = t(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("owner"), F.to_date("ts").alias("day"))
    days = hours.calendar(spark, *period(spark, sf), S).where("workday")
    numbered = days.select("day", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("day")).alias("n"))
    return sessions.gap_runs(rows, ["owner"], "day", numbered, 3)


def power_pairing(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "on").when(F.col("event_type") == "click", "off").when(F.col("event_type") == "error", "boot")
    rows = t(spark, sf, "events").select(F.col("user_id").alias("owner"), "ts", kind.alias("kind")).where("kind is not null")
    spans = sessions.power_spans(rows, ["owner"], "ts", "kind")
    return spans.groupBy("owner").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.timestamp_diff("SECOND", "start", "end")).alias("seconds"))


# -- hours and load


def day_worked_hours(spark, sf):
    return hours.day_hours(sig(spark, sf), S)


def monthly_load(spark, sf):
    return hours.monthly_load(hours.day_hours(sig(spark, sf), S), *period(spark, sf), S)


def worked_hours_floor(spark, sf):
    """The day rules: sessions, machine windows as floors and credits."""
    s = sig(spark, sf)
    traces = sessions.cap_passive(sessions.signal_sessions(s, S), S.passive_day_max_min).select("owner", "day", F.lit("session").alias("kind"), "a", "b")
    points = s.withColumn("minute", F.col("minute").cast("double"))
    machine = intervals.trace_window(points, "minute", 60.0).select("owner", "day", "a", "b")
    return hours.worked_hours(traces, machine, points.where("productive").select("owner", "day", "minute"), S)


def absence_inference(spark, sf):
    s = sig(spark, sf)
    machine = s.groupBy("owner", "day").agg(F.count(F.lit(1)).cast("double").alias("on_h"))
    return hours.inferred_absences(hours.day_hours(s, S), s.select("owner").distinct(), *period(spark, sf), machine, S)


def sampling_step(spark, sf):
    rows = t(spark, sf, "events").select("event_type", "ts")
    return hours.sampling_step(rows, ["event_type"], "ts", 60.0, 3000.0, 6000.0)


# -- sampling and caps


def even_spread_sample(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("owner"), "ts", "event_id")
    return sampling.even_spread(rows, ["owner"], ["ts", "event_id"], 8).select("owner", "event_id")


def two_level_cap(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("folder"), F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    kept = sampling.two_level_cap(rows, ["folder", "day"], ["day"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], 2, 6)
    return kept.groupBy("day").agg(F.count(F.lit(1)).alias("kept"))


def topk_with_rest(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", "p_brand", F.col("l_quantity").alias("mm"))
    return pivots.top_with_rest(rows, ["l_returnflag"], "p_brand", "mm", 14)


def mtime_clumps(spark, sf):
    rows = t(spark, sf, "events").select("event_type", "ts")
    return sampling.clumps(rows, F.hour("ts"), ["event_type"], 20, 5, 0.04, 3)


def utc_suspect(spark, sf):
    return sampling.utc_suspects(sig(spark, sf), ["owner"], F.hour("ts"), 8, 5, 0.4)


# -- joins


def oneway_sender(spark, sf):
    mail = t(spark, sf, "events").select(F.date_trunc("day", "ts").alias("conv"), F.col("user_id").alias("sender"), "event_type", F.hour("ts").alias("h")).withColumn("conv", F.concat_ws("-", F.date_format("conv", "yyyyMMdd"), (F.col("sender") % 7).cast("string"), "h"))
    return signals.one_way_senders(mail, "conv", "sender", F.col("event_type") == "purchase")


def exclude_anti(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    out = signals.exclude(rows, t(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])
    return out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def alias_left_coalesce(spark, sf):
    aliases = t(spark, sf, "part").where("p_size <= 5").select(F.col("p_partkey").cast("string").alias("alias"), F.col("p_brand").alias("canon"))
    rows = t(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), "l_quantity")
    return resolve.canonical(rows, "name", aliases).groupBy("name").agg(F.sum("l_quantity").alias("quantity"))


def scoped_alias(spark, sf):
    aliases = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit("A").alias("alias"), F.concat(F.lit("n"), "s_nationkey").alias("canon"))
    rows = t(spark, sf, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("flag"), "l_quantity")
    return resolve.canonical(rows, "flag", aliases, ["l_suppkey"]).groupBy("flag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


def program_usage_full_outer(spark, sf):
    e = t(spark, sf, "events")
    front = e.where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("front"))
    back = e.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("back"))
    return pivots.usage(front, back, ["user_id"])


def cascade_resolution(spark, sf):
    pool = t(spark, sf, "part").select(F.col("p_name")).distinct()
    rows = pool.select(F.when(F.length("p_name") % 3 == 0, F.upper("p_name")).when(F.length("p_name") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.concat("p_name", F.lit(" (new)"))).alias("raw"))
    return resolve.cascade(rows, "raw", pool, "p_name")


# -- pivots, reviews, teams


def pivot_two_way(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("model"), F.col("p_type").alias("worktype"), F.col("l_quantity").alias("mm"))
    return pivots.two_way(rows, "model", "worktype", "mm", 10)


def common_tasks(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_name", "p_brand", "l_suppkey", F.col("l_quantity").alias("mm"))
    out = pivots.common(rows, "p_name", "p_brand", "mm", 2, 15, "l_suppkey")
    return out.select("p_name", "models", "people", F.col("value").alias("mm"), "score")


def team_matrix_pivot(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_returnflag", F.col("l_quantity").alias("mm"))
    return pivots.matrix(rows, "s_nationkey", "l_returnflag", "mm", ["A", "N", "R"])


def rollup_totals(spark, sf):
    return board.subtotals(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_quantity"))


def trend_week(spark, sf):
    return pivots.trend(t(spark, sf, "events"), "ts", "week", ["event_type"])


def trend_month(spark, sf):
    return pivots.trend(t(spark, sf, "orders").withColumnRenamed("o_orderdate", "ts"), "ts", "month", ["o_orderpriority"])


def review_topk(spark, sf):
    rows = t(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    out = pivots.review(rows, F.date_format("ts", "yyyy-MM"), "event_type", {"user": F.col("user_id"), "key": F.col("k"), "hour": F.hour("ts")}, 5)
    return out.select("period", "event_type", "kind", "entry", "n", "rank")


def cfg_majority(spark, sf):
    members = t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 1500, "standard").otherwise("low").alias("cfg"))
    return team.config_mismatch(members, "c_custkey", F.col("cfg"), ["c_nationkey"])


def headcount_share(spark, sf):
    rows = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    out = team.head_counts(rows, ["o_custkey"], F.col("o_orderstatus") == "F")
    return out.select("o_orderkey", F.round("heads", 6).alias("heads"))


def lookup_mode(spark, sf):
    return pivots.mode_of(t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


def deterministic_majority(spark, sf):
    return pivots.mode_of(t(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice")


def board_by_code_split(spark, sf):
    codes = F.array_distinct(F.array("l_returnflag", "l_linestatus"))
    return board.by_code(t(spark, sf, "lineitem"), codes, F.col("l_quantity"), F.col("l_discount") >= 0.05)


def board_validation(spark, sf):
    rules = {"no_discount": F.col("l_discount") == 0, "large": F.col("l_quantity") > 45, "untaxed": F.col("l_tax") == 0, "cheap": F.col("l_extendedprice") < 2000}
    out = board.issues(t(spark, sf, "lineitem").withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), "row", rules)
    return out.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("rows"))


def stored_difference(spark, sf):
    o = t(spark, sf, "orders")
    stored = o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    computed = o.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return board.differences(stored, computed, ["o_custkey"], "v", 0.0005)


def month_window_gantt(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_returnflag", F.col("l_shipdate").cast("date").alias("day"))
    return team.months_active(rows, ["l_returnflag"], "day", 12)


def candidate_merge(spark, sf):
    parts = t(spark, sf, "part").select("p_partkey", T.identity_key(F.col("p_name")).alias("name"), "p_type")
    rows = t(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return team.merge_candidates(rows.select("name", "l_quantity", "l_suppkey", "p_type"), "name", "l_quantity", "l_suppkey", "p_type")


def history_upsert(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    out = signals.history_upsert(o, new, ["o_orderkey"], "o_orderdate", F.lit("2001-08-01").cast("timestamp_ntz"), S.retention_days, ["o_custkey"], 2)
    return out.select("o_orderkey", "o_custkey", "o_orderdate", F.round("o_totalprice", 2).alias("o_totalprice"))


# -- text, rules, names


def exclusion_ledger(spark, sf):
    text = F.col("text")
    reason = signals.first_reason(
        ("null", text.isNull()),
        ("short", F.length(text) < 40),
        ("private", P.keyword_hit(text, ["password", "ssn", "iban", "stupid"]).isNotNull()),
        ("license", F.lower(text).contains("license")),
        ("long", F.length(text) > 20000),
    )
    return signals.ledger(t(spark, sf, "documents").select(reason.alias("reason")))


def privacy_redaction(spark, sf):
    words = ["stupid", "idiot", "license"]
    text = P.redact_lines(F.coalesce("text", F.lit("")), words)
    return t(spark, sf, "documents").select("doc_id", F.length(text).alias("n_left"), P.keyword_hit(F.col("text"), words).alias("hit"))


def token_document_frequency(spark, sf):
    words = t(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 5")


def project_discovery(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", T.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    return allocation.discover_projects(rows, "p_partkey", F.col("words")).select("p_partkey", "project")


def project_match(spark, sf):
    needles = t(spark, sf, "nation").select(F.concat(F.lit("P"), "n_nationkey").alias("project"), F.element_at(F.array(*map(F.lit, ["red", "blue", "ring", "bolt", "widget", "small"])), F.col("n_nationkey") % 6 + 1).alias("needle"), F.col("n_nationkey").alias("priority"))
    rows = t(spark, sf, "part").select("p_partkey", "p_name")
    return allocation.match_projects(rows, "p_name", needles, "p_partkey").select("p_partkey", "project")


def classify_first_match(spark, sf):
    rules = [(r"\bring\b", "ring"), (r"red|blue", "coloured"), (r"^small", "small")]
    return t(spark, sf, "part").select("p_partkey", P.first_rule(F.col("p_name"), rules, "other").alias("kind"))


def longest_prefix_lookup(spark, sf):
    table = {"s": "any s", "small": "small one", "sm": "sm", "eco": "economy", "p": "p", "prom": "promo"}
    return t(spark, sf, "part").select("p_partkey", P.longest_prefix(F.col("p_type"), table).alias("label"))


def bigram_dice_pairs(spark, sf):
    pairs = resolve.similar_pairs(t(spark, sf, "part"), "p_name", 0.45)
    return pairs.select("a", "b", F.round("dice", 4).alias("dice"))


def token_jaccard_pairs(spark, sf):
    pairs = resolve.sharing_pairs(t(spark, sf, "part"), "p_name")
    return pairs.select("a", "b", F.round("jaccard", 4).alias("jaccard"))


def note_number_veto(spark, sf):
    name = F.concat("p_name", F.lit(" "), F.col("p_size"), F.when(F.col("p_size") % 2 == 0, " (even)").otherwise(""))
    return t(spark, sf, "part").select("p_partkey", T.note(name).alias("note"), F.array_join(T.numbers(name), ",").alias("numbers"), T.identity_key(T.without_note(name)).alias("key"))


def text_scalars(spark, sf):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_v"), F.col("p_size"), F.element_at(F.array(F.lit(".prt.3"), F.lit(".cas.h5"), F.lit(".DOCX")), F.col("p_size") % 3 + 1))
    clock = F.concat(F.col("p_size"), F.lit(":"), F.lpad((F.col("p_size") * 7 % 75).cast("string"), 2, "0"))
    return t(spark, sf, "part").select("p_partkey", T.base_name(name).alias("base"), T.extension(name).alias("ext"), T.minutes_of(clock).alias("minutes"), T.safe_key(name).alias("safe"))


def json_island(spark, sf):
    html = F.concat(F.lit('<html><script>x</script><script type="application/json" id="data">'), "props", F.lit("</script></html>"))
    return t(spark, sf, "events").groupBy(F.get_json_object(T.island(html, "data"), "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def page_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.length(T.strip_html(F.col("html"))).alias("n_chars"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))


def meeting_rules(spark, sf):
    o = t(spark, sf, "orders")
    reason = P.meeting_skip(F.when(F.col("o_orderstatus") == "P", "Canceled: x").otherwise("x"), (F.col("o_custkey") % 6).cast("int"), (F.col("o_orderkey") % 3).cast("int"))
    return o.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def alias_closure(spark, sf):
    """Customers' names as aliases within two scopes: chains of sixty, into a cycle of
    ten or to an end, tails that lead into a cycle, cycles of two and lone names."""
    k, r = F.col("c_custkey"), F.floor(F.col("c_custkey") % 200 / 2)
    plain = F.floor(F.col("c_custkey") / 200) % 2 == 1
    step = F.when(r < 60, 2).when(plain, None).when(r < 69, 2).when(r < 70, -18).when(r < 75, -12).when(r < 76, 2).when(r < 77, -2)
    names = t(spark, sf, "customer").withColumn("step", step)
    name = lambda key: F.concat(F.when(key % 3 == 0, "task  ").otherwise("task "), key.cast("string"))
    edges = names.where("step IS NOT NULL").select((k % 2).alias("scope"), name(k).alias("alias"), name(k + F.col("step")).alias("canon"))
    return resolve.close_aliases(edges, scope=["scope"])


def name_clusters(spark, sf):
    p = t(spark, sf, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_type")).alias("details"), F.count(F.lit(1)).alias("weight"))
    profiles = p.select(F.col("p_name").alias("name"), "details", F.lit("2024-01-01").cast("date").alias("first_day"), F.lit("2024-06-01").cast("date").alias("last_day"), F.lit(False).alias("pinned"), F.lit(None).cast("string").alias("product"), "weight")
    scores = resolve.pair_scores(resolve.candidate_pairs(profiles, "name"), profiles)
    scope = resolve.scopes(scores, profiles)
    within = scores.join(scope.withColumnRenamed("name", "a"), "a").join(scope.select(F.col("name").alias("b"), "scope"), ["b", "scope"]).select(F.col("scope").alias("scope"), "a", "b", "score")
    return resolve.clusters(within, profiles.join(scope, "name").select("scope", "name", "weight"), 6).select("name", "canon")


QUERIES = {
    f.__name__: f
    for f in (
        signal_weighted_grid,
        confidence_grade,
        share_allocation,
        strongest_signal,
        mm_rescale,
        prorata_allocation,
        coverage_grade,
        rehours_difference,
        interval_union_hours,
        interval_intersect_minutes,
        interval_subtract_minutes,
        interval_clip_day,
        interval_tail,
        fit_credit,
        day_night_split,
        midnight_split,
        trace_window,
        edge_trim,
        minute_clusters,
        burst_minutes,
        session_gap_30,
        session_active_passive,
        passive_cap,
        asof_reply,
        order_done_lead,
        episode_spans,
        evidence_gaps,
        power_pairing,
        day_worked_hours,
        monthly_load,
        worked_hours_floor,
        absence_inference,
        sampling_step,
        even_spread_sample,
        two_level_cap,
        topk_with_rest,
        mtime_clumps,
        utc_suspect,
        oneway_sender,
        exclude_anti,
        alias_left_coalesce,
        scoped_alias,
        program_usage_full_outer,
        cascade_resolution,
        pivot_two_way,
        common_tasks,
        team_matrix_pivot,
        rollup_totals,
        trend_week,
        trend_month,
        review_topk,
        cfg_majority,
        headcount_share,
        lookup_mode,
        deterministic_majority,
        board_by_code_split,
        board_validation,
        stored_difference,
        month_window_gantt,
        candidate_merge,
        history_upsert,
        exclusion_ledger,
        privacy_redaction,
        token_document_frequency,
        project_discovery,
        project_match,
        classify_first_match,
        longest_prefix_lookup,
        bigram_dice_pairs,
        token_jaccard_pairs,
        note_number_veto,
        text_scalars,
        json_island,
        page_text,
        meeting_rules,
        alias_closure,
        name_clusters,
    )
}
