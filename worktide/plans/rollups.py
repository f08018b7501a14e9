"""Queries on judged rows, funnel, names and rules, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from worktide.functions import config, predicates as P, text as T
from worktide.operators import judged as J, signals, team
from worktide.sources import traces


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judged_signals(spark, sf) -> DataFrame:
    rows = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("l_suppkey") % 5).alias("owner"), F.col("p_brand").alias("model"), F.col("p_name").alias("detail"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("source"),
        F.col("l_quantity").alias("weight"), F.when(F.col("l_linenumber") % 3 > 0, F.col("p_type")).alias("worktype"),
    )


_SIG = """s AS (
  SELECT l_suppkey % 5 AS owner, p_brand AS model, p_name AS detail, CAST(l_shipdate AS DATE) AS day, l_returnflag AS source, l_quantity AS weight,
    CASE WHEN l_linenumber % 3 > 0 THEN p_type ELSE 'office' END AS worktype FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def judged_rows(spark, sf):
    products = _t(spark, sf, "part").select(F.col("p_brand").alias("model"), F.when(F.startswith("p_brand", F.lit("Brand#1")), "common").when(F.startswith("p_brand", F.lit("Brand#2")), "Laser").alias("product")).where("product IS NOT NULL")
    return J.judged_rows(judged_signals(spark, sf), F.lit(3.0), products)


def signal_stats(spark, sf):
    return J.signal_stats(judged_signals(spark, sf), ["R"])


def report_rows(spark, sf):
    s = judged_signals(spark, sf)
    rows = s.select(F.col("model").alias("level2"), F.concat(F.lit(" "), "detail").alias("level3"), (F.col("weight") / 10).alias("mm"), (F.col("weight") / 100).alias("share"), F.col("worktype").alias("description"), F.col("source").alias("evidence"))
    return J.report_rows(rows, ["level2", "level3"])


def project_clusters(spark, sf):
    p = _t(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.replace("p_brand", F.lit("#"), F.lit("# ")), F.lit("_")))
    clusters = p.select(F.col("p_partkey").alias("cluster"), name.alias("project"), (F.col("p_size") / 4.0).alias("mm"), (F.col("p_size") / 8.0).alias("ax_mm"), F.lit(1).alias("flows"))
    people = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("cluster"), (F.col("l_suppkey") % 9).alias("who"))
    return J.by_project(clusters, people)


def automation_ratio(spark, sf):
    grade = F.when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "mid").otherwise("low")
    return J.automation_ratio(_t(spark, sf, "events").select("user_id", grade.alias("grade")), ["user_id"], "grade")


def worktype_sums(spark, sf):
    return J.worktype_sums(judged_signals(spark, sf).na.fill("none", ["worktype"]).withColumnRenamed("weight", "mm"))


def flow_mm(spark, sf):
    """Flows from customers: own value, else details, else measured rows of project and
    detail, of one of them, or nothing."""
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    flows = c.select(k.alias("flow"), (k % 5).alias("owner"), F.when(k % 4 < 2, F.concat(F.lit("brand # "), (k % 25 + 1).cast("string"))).alias("project"), F.when(k % 4 % 2 == 0, F.element_at(F.array(F.lit("Cold-Widget"), F.lit("large bolt"), F.lit("nothing")), (k % 3 + 1).cast("int"))).alias("detail"), F.when(k % 7 == 0, 2.5).when(k % 7 == 1, 0.0).alias("mm"))
    details = c.where("c_custkey % 6 = 1").select(k.alias("flow"), (F.col("c_nationkey") / 4.0).alias("mm"))
    s = judged_signals(spark, sf)
    return J.flow_mm(flows, details, s.select("owner", F.replace("model", F.lit("#"), F.lit("_#_")).alias("project"), "detail", F.col("weight").alias("mm")))


def fold_small(spark, sf):
    return J.fold_small(judged_signals(spark, sf).select("owner", "source", F.col("model").alias("project"), (F.col("weight") / 1000).alias("mm")), ["owner", "source"], "project", 0.6)


def self_names(spark, sf):
    """Files of owners of whom some are configured; the others' own share of files varies."""
    owner = F.col("l_partkey") % 60
    own = F.concat(F.lit("CORP\\Ann."), owner.cast("string"), F.lit(" (Lab)"))
    other = F.concat(F.lit("bob-"), (F.col("l_suppkey") % 4).cast("string"), F.lit("@x.com"))
    files = _t(spark, sf, "lineitem").select(owner.alias("owner"), F.when(F.col("l_orderkey") % 10 < owner % 10, own).otherwise(other).alias("author"), F.col("l_returnflag").alias("folder"), F.col("l_shipdate").alias("at"))
    known = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("owner"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Kim-"), "n_nationkey")).otherwise(F.lit("k")).alias("name"))
    return team.self_names(files, known)


def unit_priorities(spark, sf):
    units = _t(spark, sf, "part").select((F.col("p_partkey") % 3).alias("owner"), F.col("p_type").alias("level1"), F.col("p_brand").alias("project"), F.concat("p_name", F.lit(" "), "p_partkey").alias("unit"), F.col("p_size").cast("double").alias("mm"), (F.col("p_partkey") % 11).alias("weight"))
    return J.priorities(units, ["owner"], ["PROMO", "SMALL"]).select("owner", "unit", "place")


def best_matches(spark, sf):
    answers = _t(spark, sf, "events").select((F.col("user_id") % 40).alias("owner"), F.col("event_type").alias("task"), F.col("event_id").alias("batch"), (F.col("event_id") * 13 % 140 - 20).cast("string").alias("fit"), F.concat(F.lit("r"), "event_id").alias("reason"), F.array(F.concat(F.lit("w"), F.col("event_id") % 12), F.concat(F.lit("w"), F.col("event_id") % 5)).alias("work"))
    return J.best_matches(answers, ["owner", "task"], 4)


def source_inventory(spark, sf):
    e = _t(spark, sf, "events")
    expected = spark.createDataFrame([("click", False), ("web", False), ("purchase", False), ("mail", True), ("calendar", False)], "source string, optional boolean")
    as_of = F.lit("2024-02-20").cast("date")
    rows = e.select(F.when((F.col("event_type") == "click") & (F.col("event_id") >= 20), "web").otherwise(F.col("event_type")).alias("source"), F.col("ts").alias("at"))
    return J.source_inventory(rows, expected, as_of, 25, 1000).select("source", "n", "age_days", "status")


def month_coverage(spark, sf):
    return J.month_coverage(_t(spark, sf, "orders"), ["o_orderstatus"], "o_orderdate", "1992-01-01", "2002-12-31")


def reliable_comparison(spark, sf):
    members = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.when(F.col("c_acctbal") < 0, "unreliable").when(F.col("c_custkey") % 9 > 0, "good").alias("grade"))
    return J.compared(members, ["c_nationkey"], "grade", F.col("c_acctbal"), "difference").select("c_custkey", "reliable", "difference")


# -- the funnel and rules


def _funnel(spark, sf):
    e = _t(spark, sf, "events")
    rows = e.select(F.col("ts").alias("at"), F.when(F.col("event_type") == "signup", "file").otherwise(F.col("event_type")).alias("source"), F.when(F.col("event_id") % 31 == 0, "  ").otherwise(F.concat(F.lit("note "), F.col("event_id") % 97)).alias("text"), (F.col("event_id") % 7 / 2.0).alias("weight"), "event_id")
    keyed = rows.withColumns({"hour": F.date_trunc("hour", "at").cast("timestamp_ntz"), "who": F.col("event_id") % 3})
    private = P.keyword_hit(F.col("text"), ["note 13", "note 14"])
    return signals.ingest(keyed, ["hour", "source", "who"], "2024-01-03", "2024-01-25", private, F.when(F.col("text").rlike(r"5$"), "five"), "event_id")


def ingested_signals(spark, sf):
    return _funnel(spark, sf)[0].select("hour", "source", "who", "event_id", "weight")


def ingestion_ledger(spark, sf):
    return _funnel(spark, sf)[1]


_FUNNEL = """e AS (
  SELECT event_id, ts, date_trunc('hour', ts) AS hour, event_id % 3 AS who, CASE WHEN event_type = 'signup' THEN 'file' ELSE event_type END AS source,
    CASE WHEN event_id % 31 = 0 THEN '' ELSE 'note ' || (event_id % 97) END AS text, (event_id % 7 / 2.0)::DOUBLE AS weight FROM events
), b AS (SELECT *, row_number() OVER (PARTITION BY hour, source, who ORDER BY weight DESC, event_id) AS i FROM e WHERE text <> ''
), r AS (SELECT *, CASE WHEN NOT CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' THEN 'period' WHEN text IN ('note 13', 'note 14') THEN 'private' WHEN source <> 'file' AND text LIKE '%5' THEN 'non-work' END AS reason FROM b WHERE i = 1)"""


def notice_senders(spark, sf):
    e = _t(spark, sf, "events")
    name = F.element_at(F.array(*map(F.lit, ("Notice / Team", "Noticeboard Kim", "no-reply@x", "helpdesk-2", "Ann Lee", "IT help"))), (F.col("user_id") % 6 + 1).cast("int"))
    mail = e.select("event_id", "event_type", F.concat(name, F.lit(" "), F.col("user_id") * 31 + F.col("event_id") % 31).alias("sender"))
    out = signals.notices(mail, "sender", P.is_notice(F.col("sender"), ["notice", "no-reply", "helpdesk"], ["notice"]), mail.where("event_type = 'purchase'"))
    return out.groupBy("sender").agg(F.max("notice").alias("notice"), F.count(F.lit(1)).alias("n"))


def simulation_outputs(spark, sf):
    p = _t(spark, sf, "lineitem").select((F.col("l_orderkey") % 400).alias("folder"), F.concat(F.lit("."), F.element_at(F.array(*map(F.lit, ("out", "dat", "f06", "log", "docx"))), ((F.col("l_partkey") + F.col("l_orderkey") * 3) % F.when(F.col("l_orderkey") % 2 == 0, 4).otherwise(5) + 1).cast("int"))).alias("ext"), (F.col("l_suppkey") % 5).alias("base"))
    return signals.simulation_outputs(p, ["folder"], [".out", ".dat", ".f06", ".log"])


def non_projects(spark, sf):
    names = _t(spark, sf, "part").select("p_brand").distinct()
    known = spark.createDataFrame([("Brand#11", True), ("Brand#25", False)], "name string, is_project boolean")
    return signals.non_projects(names, "p_brand", known, F.col("p_brand").rlike(r"#1\d$"))


def window_rules(spark, sf):
    e, k = _t(spark, sf, "events"), F.col("event_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    process, title = pick(("vim", "Excel.exe", "svchost.exe", "explorer", "")), pick(("main.py - x", "budget.xlsx", "notes", "run.sql"))
    folder, opened = pick((r"C:\Temp\a", "D:/work", r"x\INetCache\y")), F.col("ts")
    target = F.timestamp_add("SECOND", -(k * 7 % 300), opened)
    rules = e.select("event_type", P.is_ide(process, title, ["vim", "visual studio"], [".py", ".sql"]).alias("ide"), P.is_noise(process, ["svchost", "explorer"]).alias("noise"), P.is_view_only(folder, opened, target, [r"\temp" + "\\", "inetcache"]).alias("viewed"))
    return rules.groupBy("event_type", "ide", "noise", "viewed").agg(F.count(F.lit(1)).alias("n"))


def name_scalars(spark, sf):
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    who = F.concat(F.lit("CORP\\"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("@x.com"))
    subject = F.concat(F.lit("RE: Fw: [note] "), "p_name", F.lit("  "), F.col("p_type"))
    text = F.concat("p_name", F.lit(".PRT and "), F.col("p_size"), F.lit(" more \u00a7 hint | folder:x"))
    return p.select(
        k, T.person(who).alias("person"), T.signal_name(F.concat("p_name", F.lit(".PRT and "), "p_size", F.lit(" more | folder:x"))).alias("signal"), T.loose(F.concat(F.lit("["), "p_name", F.lit("]_("), "p_type", F.lit(")"))).alias("loose"),
        T.core(subject).alias("core"), F.array_join(T.detail_words(F.concat("p_name", F.lit(" / work-"), "p_type")), " ").alias("words"), T.count_or(F.when(k % 3 == 0, "x").when(k % 3 == 1, "7"), F.when(k % 5 == 0, F.array(k, k))).alias("count"),
        P.snap(F.substring("p_type", 1, 4), ["Economy", "Promotion", "Standard", "Small", "Smart"]).alias("category"), P.match_score(F.concat_ws(" ", "p_name", "p_type"), "widget", ["promo"], ["large", "standard", "bolt"]).alias("score"), F.substring_index(T.signal_name(text), " ", 1).alias("first"),
    )


def file_names(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, (".prt.3", ".cas.h5", ".DOCX", ".7z", ".sldprt", "", ".2024"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_size", tail)
    return _t(spark, sf, "part").select("p_partkey", T.base_name(name).alias("base"), T.extension(name).alias("ext"), T.row_signature(name, F.lit(None)).isNotNull().alias("signed"))


def rule_scalars(spark, sf):
    """Small rules of text, time and number on values that hit each of their cases."""
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    pick = lambda *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k % len(values) + 1).cast("int"))
    return p.select(
        k, T.month_key(F.date_add(F.lit("2024-01-15").cast("date"), (k % 60).cast("int"))).alias("month"), T.heat_bucket(k % 11, F.lit(10)).alias("heat"), T.percent(k % 7 / 2.0).alias("percent"), T.number_or(pick("3.5", "x", "NaN", "Infinity", None), 9.0).alias("number"),
        T.domain_only(pick("Ann <a@X.com>", "none", None)).alias("domain"), T.folder_label(pick("C:\\Data\\2024\\Wing", "/documents/tmp", "D:/a/Desktop")).alias("folder"), T.strict_timestamp(pick("2024-01-02 26:00:00", "2024-01-02 10:30", "2024-01-02")).alias("at"),
        P.is_half_day(pick("half day off", "whole", "PM off")).alias("half"), P.is_placeholder(pick("<name>", "<a> b", " <x> ")).alias("placeholder"), P.has_token_suffix(pick("annual myleave", "2leave", "notice"), ["leave"]).alias("leave"), P.is_me(pick("", "Kim Ann", "bob"), ["kimann"]).alias("me"),
    )


def config_refusals(spark, sf):
    """Each customer's setting, kept or refused, with the reason."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ("std_day_h", "burst_n", "session_gap_min", "colour", "lunch", "day_window", "min_weight"))), (k % 7 + 1).cast("int"))
    value = F.when(k % 11 == 0, "x").when(k % 5 == 0, F.concat_ws(",", (k % 9).cast("string"), (k % 13).cast("string"))).otherwise(F.concat(F.floor(F.col("c_acctbal") / 10).cast("string"), F.when(k % 2 == 0, ".5").otherwise("")))
    return config.judged_settings(_t(spark, sf, "customer").select("c_custkey", name.alias("name"), value.alias("value")))


def file_choice(spark, sf):
    """For each customer the file whose total is nearest to the official one."""
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), "c_acctbal")
    files = o.select(F.col("o_custkey").alias("owner"), F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp").alias("at")).join(c, "owner")
    return traces.best_file(files, "owner", F.col("total"), F.col("c_acctbal") * 10, F.col("at"))


def refined_rows(spark, sf):
    """Refined rows of customers where they are not older than the plain ones."""
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey", F.col("o_orderdate").alias("at"))
    plain, refined = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")  # two tables of one
    return traces.refined_or_plain(plain, refined, "owner", "at").select("owner", "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        judged_rows, signal_stats, report_rows, project_clusters, automation_ratio, worktype_sums, flow_mm, fold_small, self_names, unit_priorities, best_matches, source_inventory, month_coverage, reliable_comparison,
        ingested_signals, ingestion_ledger, notice_senders, simulation_outputs, non_projects, window_rules, name_scalars, file_names, rule_scalars, config_refusals, file_choice, refined_rows,
    )
}

ORACLE_SQL = {
    "judged_rows": f"""WITH {_SIG}, c AS (SELECT owner, model, detail, sum(weight) AS w, count(DISTINCT day) AS days, count(DISTINCT source) AS sources FROM s GROUP BY 1, 2, 3),
k AS (SELECT owner, model, detail, worktype, row_number() OVER (PARTITION BY owner, model, detail ORDER BY count(*) DESC, worktype) AS i FROM s GROUP BY 1, 2, 3, 4),
v AS (SELECT owner, model, detail, string_agg(source || ' ' || n, ', ' ORDER BY n DESC, source) AS evidence FROM (SELECT owner, model, detail, source, count(*) AS n FROM s GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
h AS (SELECT *, w / sum(w) OVER (PARTITION BY owner) AS share FROM c)
SELECT h.owner, h.model, h.detail, CASE WHEN h.model LIKE 'Brand#1%' THEN 'common: ' || h.detail WHEN h.model LIKE 'Brand#2%' THEN 'Laser' ELSE h.model END AS product, k.worktype, round(share, 4) AS share, round(share * 3.0, 3) AS mm, v.evidence,
  CASE WHEN sources >= 2 AND days >= 3 THEN 'high' WHEN sources >= 2 OR days >= 3 THEN 'mid' ELSE 'low' END AS confidence, days
FROM h JOIN k ON k.i = 1 AND (k.owner, k.model, k.detail) = (h.owner, h.model, h.detail) JOIN v ON (v.owner, v.model, v.detail) = (h.owner, h.model, h.detail)""",
    "signal_stats": f"WITH {_SIG} SELECT lower(model) AS model, lower(detail) AS detail, count(*) AS total, count(*) FILTER (source = 'R') AS passive FROM s GROUP BY 1, 2",
    "report_rows": f"""WITH {_SIG} SELECT model AS level2, detail AS level3, round(sum(weight / 10), 3) AS mm, round(sum(weight / 100), 4) AS share,
  coalesce(string_agg(DISTINCT CASE WHEN worktype <> 'office' THEN worktype END, '; ' ORDER BY CASE WHEN worktype <> 'office' THEN worktype END), '') AS description, string_agg(DISTINCT source, '; ' ORDER BY source) AS evidence FROM s GROUP BY 1, 2""",
    "project_clusters": """WITH c AS (SELECT p_partkey AS cluster, p_brand AS b, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE replace(p_brand, '#', '# ') || '_' END AS project, p_size FROM part),
w AS (SELECT l_partkey AS cluster, l_suppkey % 9 AS who FROM lineitem), h AS (SELECT cluster, count(DISTINCT who) AS n FROM w GROUP BY 1)
SELECT arg_min(project, (-length(project), project)) AS project, round(sum(p_size / 4.0), 2)::DOUBLE AS mm, round(sum(p_size / 8.0), 2)::DOUBLE AS ax_mm, count(*) AS flows, count(*) AS types, count(*) FILTER (n > 1) AS shared,
  coalesce((SELECT count(DISTINCT who) FROM w JOIN c c2 USING (cluster) WHERE c2.b = c.b), 0) AS people FROM c LEFT JOIN h USING (cluster) GROUP BY b""",
    "automation_ratio": "SELECT user_id, count(*) AS steps, round(avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.0 END), 4)::DOUBLE AS ax FROM events GROUP BY 1",
    "worktype_sums": f"WITH {_SIG} SELECT owner, CASE WHEN worktype = 'office' THEN 'none' ELSE worktype END AS worktype, round(sum(weight), 3) AS mm FROM s GROUP BY 1, 2",
    "flow_mm": f"""WITH {_SIG}, f AS (
  SELECT c_custkey AS flow, c_custkey % 5 AS owner, CASE WHEN c_custkey % 4 < 2 THEN 'Brand#' || (c_custkey % 25 + 1) END AS p, CASE WHEN c_custkey % 4 % 2 = 0 THEN (['cold widget', 'large bolt', 'nothing'])[c_custkey % 3 + 1] END AS d,
    CASE WHEN c_custkey % 7 = 0 THEN 2.5 END AS own, CASE WHEN c_custkey % 6 = 1 THEN nullif(c_nationkey / 4.0::DOUBLE, 0) END AS listed FROM customer
), m AS (SELECT flow, own, listed, p, d, (SELECT sum(weight) FROM s WHERE s.owner = f.owner AND (f.p IS NULL OR s.model = f.p) AND (f.d IS NULL OR s.detail = f.d)) AS measured FROM f)
SELECT flow, round(coalesce(own, listed, CASE WHEN p IS NULL AND d IS NULL THEN 0.0 ELSE measured END, 0.0), 3)::DOUBLE AS mm FROM m""",
    "fold_small": f"""WITH {_SIG}, t AS (SELECT owner, source, model AS project, sum(weight / 1000) AS mm FROM s GROUP BY 1, 2, 3), b AS (SELECT *, bool_or(mm >= 0.6) OVER (PARTITION BY owner, source) AS any_big FROM t)
SELECT owner, source, CASE WHEN mm < 0.6 AND any_big THEN 'others' ELSE project END AS project, round(sum(mm), 3) AS mm FROM b GROUP BY 1, 2, 3""",
    "self_names": """WITH g AS (SELECT DISTINCT l_partkey % 60 AS owner, CASE WHEN l_orderkey % 10 < l_partkey % 60 % 10 THEN 'ann' || (l_partkey % 60) ELSE 'bob' || (l_suppkey % 4) END AS name, l_returnflag, CAST(l_shipdate AS DATE) AS d FROM lineitem),
k AS (SELECT n_nationkey AS owner, 'kim' || n_nationkey AS name FROM nation WHERE n_nationkey % 2 = 0), v AS (SELECT owner, name, count(*) AS votes FROM g GROUP BY 1, 2),
r AS (SELECT *, sum(votes) OVER (PARTITION BY owner)::BIGINT AS total, row_number() OVER (PARTITION BY owner ORDER BY votes DESC, name) AS i FROM v)
SELECT owner, name, NULL::BIGINT AS votes, NULL::BIGINT AS "of" FROM k
UNION ALL SELECT owner, name, votes, total FROM r WHERE i = 1 AND votes >= 3 AND votes * 2 >= total AND owner NOT IN (SELECT owner FROM k)""",
    "unit_priorities": """WITH u AS (SELECT p_partkey % 3 AS owner, p_type, p_brand, p_name || ' ' || p_partkey AS unit, p_partkey % 11 AS w, sum(p_size) OVER (PARTITION BY p_partkey % 3, p_brand) AS t FROM part)
SELECT owner, unit, CAST(row_number() OVER (PARTITION BY owner ORDER BY CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END, t DESC, p_brand, w DESC, unit) AS INTEGER) AS place FROM u""",
    "best_matches": """WITH a AS (SELECT user_id % 40 AS owner, event_type AS task, event_id AS batch, least(event_id * 13 % 140 - 20, 100) AS fit, 'r' || event_id AS reason, ['w' || (event_id % 12), 'w' || (event_id % 5)] AS work FROM events),
g AS (SELECT * FROM a WHERE fit > 0), w AS (SELECT owner, task, w, min(batch) AS b FROM (SELECT owner, task, batch, UNNEST(work) AS w FROM g) GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY owner, task ORDER BY b, w) AS i FROM w), l AS (SELECT owner, task, string_agg(w, '; ' ORDER BY i) AS work FROM n WHERE i <= 4 GROUP BY 1, 2)
SELECT g.owner, g.task, CAST(max(fit) AS INTEGER) AS fit, arg_min(reason, (-fit, batch)) AS reason, any_value(l.work) AS work FROM g JOIN l ON l.owner = g.owner AND l.task = g.task GROUP BY 1, 2""",
    "source_inventory": """WITH x(source, optional) AS (VALUES ('click', false), ('web', false), ('purchase', false), ('mail', true), ('calendar', false)),
f AS (SELECT CASE WHEN event_type = 'click' AND event_id >= 20 THEN 'web' ELSE event_type END AS source, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1)
SELECT x.source, coalesce(n, 0) AS n, CAST(DATE '2024-02-20' - CAST(newest AS DATE) AS INTEGER) AS age_days,
  CASE WHEN n IS NULL THEN CASE WHEN optional THEN 'off' ELSE 'bad' END WHEN n < 1000 OR DATE '2024-02-20' - CAST(newest AS DATE) > 25 THEN 'warn' ELSE 'ok' END AS status FROM x LEFT JOIN f USING (source)""",
    "month_coverage": """WITH m AS (SELECT CAST(UNNEST(generate_series(DATE '1992-01-01', DATE '2002-12-31', INTERVAL 1 MONTH)) AS DATE) AS m), k AS (SELECT DISTINCT o_orderstatus FROM orders)
SELECT k.o_orderstatus, strftime(m, '%Y-%m') AS month, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = k.o_orderstatus AND date_trunc('month', o.o_orderdate) = m.m) AS covered FROM k, m""",
    "reliable_comparison": """WITH c AS (SELECT *, c_acctbal >= 0 AS reliable FROM customer)
SELECT c_custkey, reliable, CASE WHEN reliable THEN round(c_acctbal - avg(c_acctbal) FILTER (reliable) OVER (PARTITION BY c_nationkey), 4) END AS difference FROM c""",
    "ingested_signals": f"WITH {_FUNNEL} SELECT hour, source, who, event_id, weight FROM r WHERE reason IS NULL",
    "ingestion_ledger": f"""WITH {_FUNNEL}, c AS (
  SELECT reason, CASE reason WHEN 'private' THEN text WHEN 'non-work' THEN 'five' END AS word FROM r WHERE reason IS NOT NULL
  UNION ALL SELECT 'duplicate', NULL FROM b WHERE i > 1 UNION ALL SELECT 'empty', NULL FROM e WHERE text = ''
) SELECT reason, word, count(*) AS n FROM c GROUP BY 1, 2""",
    "notice_senders": """WITH m AS (SELECT event_id, event_type, user_id, (['Notice / Team', 'Noticeboard Kim', 'no-reply@x', 'helpdesk-2', 'Ann Lee', 'IT help'])[user_id % 6 + 1] || ' ' || (user_id * 31 + event_id % 31) AS sender FROM events),
r AS (SELECT DISTINCT sender FROM m WHERE event_type = 'purchase')
SELECT sender, any_value(user_id % 6 IN (0, 2, 3)) AND sender NOT IN (SELECT sender FROM r) AS notice, count(*) AS n FROM m GROUP BY sender""",
    "simulation_outputs": """WITH f AS (SELECT l_orderkey % 400 AS folder, (['out', 'dat', 'f06', 'log', 'docx'])[(l_partkey + l_orderkey * 3) % CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE 5 END + 1] AS ext, l_suppkey % 5 AS base FROM lineitem),
b AS (SELECT folder, base, count(*) AS n FROM f GROUP BY 1, 2), s AS (SELECT folder, sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS shared FROM b GROUP BY 1),
g AS (SELECT folder, count(*) AS n, count(*) FILTER (ext <> 'docx') AS o, count(DISTINCT ext) AS kinds FROM f GROUP BY 1)
SELECT folder, n, kinds FROM g JOIN s USING (folder) WHERE o * 10 >= n * 9 AND (kinds <= 2 OR shared * 2 >= n)""",
    "non_projects": "SELECT DISTINCT p_brand, CASE p_brand WHEN 'Brand#11' THEN false WHEN 'Brand#25' THEN true ELSE regexp_matches(p_brand, '#1[0-9]$') END AS nonproject FROM part",
    "window_rules": """WITH x AS (SELECT event_type, event_id AS k FROM events)
SELECT event_type, k % 5 = 0 OR k % 4 IN (0, 3) AS ide, k % 5 IN (2, 3, 4) AS noise, k % 3 IN (0, 2) OR k * 7 % 300 > 120 AS viewed, count(*) AS n FROM x GROUP BY 1, 2, 3, 4""",
    "name_scalars": r"""WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(p_type) AS ty FROM part)
SELECT p_partkey, replace(p_name, ' ', '') AS person, p_name || '.prt' AS signal, p_name || ' ' || ty AS loose, p_name || ' ' || ty AS core, array_to_string(list_sort(list_distinct([w1, w2, ty])), ' ') AS words,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 7 ELSE 0 END AS INTEGER) AS count,
  CASE substr(p_type, 1, 3) WHEN 'ECO' THEN 'Economy' WHEN 'PRO' THEN 'Promotion' WHEN 'STA' THEN 'Standard' ELSE '' END AS category,
  CASE WHEN p_name LIKE '%widget%' OR ty LIKE 'promo%' THEN 1.0 WHEN len(list_filter(list_distinct([w1, w2, ty]), lambda x: x IN ('large', 'standard', 'bolt'))) >= 2 THEN 0.67 ELSE 0.0 END::DOUBLE AS score, w1 AS first FROM p""",
    "rule_scalars": r"""SELECT p_partkey, strftime(DATE '2024-01-15' + CAST(p_partkey % 60 AS INTEGER), '%Y-%m') AS month, CAST(least(5, floor(p_partkey % 11 / 10.0 * 6)) AS INTEGER) AS heat,
  (p_partkey % 7 // 2) || CASE WHEN p_partkey % 7 % 2 = 1 THEN '.5%' ELSE '%' END AS percent, CASE WHEN p_partkey % 5 = 0 THEN 3.5 ELSE 9.0 END::DOUBLE AS number, CASE WHEN p_partkey % 3 = 0 THEN '@x.com' ELSE '(none)' END AS domain,
  (['Wing', NULL, 'a'])[p_partkey % 3 + 1] AS folder, ([NULL, TIMESTAMP '2024-01-02 10:30:00', TIMESTAMP '2024-01-02 00:00:00'])[p_partkey % 3 + 1] AS "at", p_partkey % 3 <> 1 AS half, p_partkey % 3 <> 1 AS placeholder, p_partkey % 3 = 0 AS leave, p_partkey % 3 <> 2 AS me FROM part""",
    "config_refusals": """WITH r AS (SELECT c_custkey, (['std_day_h', 'burst_n', 'session_gap_min', 'colour', 'lunch', 'day_window', 'min_weight'])[c_custkey % 7 + 1] AS name,
  CASE WHEN c_custkey % 11 = 0 THEN 'x' WHEN c_custkey % 5 = 0 THEN (c_custkey % 9) || ',' || (c_custkey % 13) ELSE CAST(floor(c_acctbal / 10) AS BIGINT) || CASE WHEN c_custkey % 2 = 0 THEN '.5' ELSE '' END END AS value FROM customer
), n AS (SELECT *, TRY_CAST(value AS DOUBLE) AS x FROM r)
SELECT c_custkey, name, value, CASE WHEN name = 'colour' THEN 'unknown' WHEN name IN ('lunch', 'day_window') THEN CASE WHEN value LIKE '%,%' THEN NULL ELSE 'not a pair or list' END
  WHEN x IS NULL OR (name = 'burst_n' AND x <> floor(x)) THEN 'not a number' WHEN x < CASE name WHEN 'std_day_h' THEN 1 WHEN 'burst_n' THEN 2 ELSE 0 END OR x > CASE name WHEN 'std_day_h' THEN 24 WHEN 'burst_n' THEN 1000 WHEN 'session_gap_min' THEN 240 ELSE 100 END THEN 'out of range' END AS reason FROM n""",
    "file_choice": """SELECT o_custkey AS owner, first('f' || o_orderkey ORDER BY abs(o_totalprice - c_acctbal * 10), o_orderdate DESC, 'f' || o_orderkey) AS path FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "refined_rows": """WITH m AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderkey % 2 = 1) AS r, max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS p FROM orders GROUP BY 1)
SELECT o_custkey AS owner, o_orderkey FROM orders JOIN m USING (o_custkey) WHERE o_orderkey % 2 = CASE WHEN r IS NOT NULL AND (p IS NULL OR r >= p) THEN 1 ELSE 0 END""",
    "file_names": """WITH n AS (SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '_' || p_size AS stem, p_partkey % 7 AS k FROM part)
SELECT p_partkey, stem AS base, (['prt', 'cas.h5', 'docx', '7z', 'sldprt', '', '2024'])[k + 1] AS ext, true AS signed FROM n""",
}
