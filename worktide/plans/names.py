"""Queries on names, details and evidence, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from worktide.operators import agentic, flows, grouping, merge_map, resolve
from worktide.sources.sinks import stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _detail():
    k, first, last = F.col("p_partkey"), F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    kind = F.lower("p_type")
    return (
        F.when(k % 7 == 0, last).when(k % 7 == 1, F.concat_ws(" ", last, kind)).when(k % 7 == 2, F.concat_ws("/", kind, first, last)).when(k % 7 == 3, F.concat("p_name", F.lit(" (new)")))
        .when(k % 7 == 4, F.concat("p_name", F.lit(" "), kind, F.lit(" (new)"))).when(k % 7 == 5, F.concat_ws("_", first, kind)).otherwise("misc task")
    )


_DETAIL = """CASE k % 7 WHEN 0 THEN l WHEN 1 THEN l || ' ' || ty WHEN 2 THEN ty || '/' || f || '/' || l WHEN 3 THEN n || ' (new)' WHEN 4 THEN n || ' ' || ty || ' (new)' WHEN 5 THEN f || '_' || ty ELSE 'misc task' END"""
_PART = "SELECT p_partkey AS k, p_brand AS brand, p_size AS size, p_name AS n, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l, lower(p_type) AS ty FROM part"


def merged_details(spark, sf):
    """Details of brands' parts under one name each; brands' one-word names that end in
    a p_size of 50 were chosen before."""
    rows = _t(spark, sf, "part").select("p_brand", _detail().alias("detail"), "p_size")
    fixed = rows.where("p_size = 50").select("p_brand", "detail").distinct()
    return grouping.merged_details(rows, "p_brand", "detail", "p_size", fixed)


def similar_names(spark, sf):
    """Parts' names as people type them, one label for those that are alike."""
    k = F.col("p_partkey")
    typed = F.when(k % 5 == 0, F.col("p_name")).when(k % 5 == 1, F.concat("p_name", F.lit(" "), F.lower("p_type"))).when(k % 5 == 2, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k % 5 == 3, F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit("s"))).otherwise(F.concat(F.initcap("p_name"), F.lit(" (x)")))
    return grouping.similar_groups(_t(spark, sf, "part").select(typed.alias("typed"), "p_partkey"), "typed", "p_partkey")


def evidence_rows(spark, sf):
    """For names as a model answers them, the brands' detail rows that they mean."""
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    rows = p.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("row"))
    asked = F.when(k % 6 == 0, F.concat_ws(" ", "p_brand", "p_name")).when(k % 6 == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).when(k % 6 == 2, F.replace("p_name", F.lit(" "), F.lit(""))).when(k % 6 == 3, F.expr("substr(p_name, 2, length(p_name) - 2)")).when(k % 6 == 4, F.concat(F.lit("re"), "p_name", F.lower("p_type"))).otherwise("abc")
    return grouping.evidence(p.select(asked.alias("asked")), "asked", rows, "row", [F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name")])


def project_inputs(spark, sf) -> dict[str, DataFrame]:
    """Five owners' projects from parts: names with spellings, details, products and
    days; every customer's segment counts as a pinned name."""
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    name = F.when(k % 6 < 3, F.col("p_name")).when(k % 6 == 3, F.replace("p_name", F.lit(" "), F.lit("-"))).when(k % 6 == 4, F.concat("p_name", F.lit(" (new)"))).otherwise(F.concat("p_name", F.lit(" ")  , (k % 2 + 1).cast("string")))
    rows = p.select((k % 5).alias("owner"), name.alias("name"), (F.col("p_size") / 8.0).alias("mm"), F.concat_ws(" ", F.lower("p_type"), (F.col("p_size") % 7).cast("string")).alias("detail"), F.when(k % 40 == 0, F.col("p_brand")).alias("product"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 120).cast("int")).alias("day"))
    pinned = _t(spark, sf, "customer").select(F.lower("c_mktsegment").alias("name")).distinct().union(p.where("p_size = 50").select(F.col("p_name").alias("name")).distinct())
    known = merge_map.profiles(rows, "owner", "name", "mm", "detail", "product", rows.select("owner", "name", "day"), pinned)
    never = p.where("p_size = 1").select(F.col("p_name").alias("a"), F.replace("p_name", F.lit(" "), F.lit(" s")).alias("b"))
    refined = rows.where("mm > 6").groupBy("owner", "day").agg(F.array_sort(F.collect_set("name")).alias("n")).where(F.size("n") == 2).select("owner", F.col("n")[0].alias("a"), F.col("n")[1].alias("b"))
    old = rows.where("mm < 0.3").groupBy("owner").agg(F.array_sort(F.collect_set("name")).alias("n")).where(F.size("n") >= 2).select("owner", F.col("n")[1].alias("alias"), F.col("n")[0].alias("canon"))
    return {"known": known, "never": never, "refined": refined, "old": old}


def project_pairs(spark, sf):
    """Pairs of project names with any evidence, their score and what follows from it."""
    i = project_inputs(spark, sf)
    return merge_map.pairs(i["known"], i["never"], i["refined"])


def project_merges(spark, sf):
    """The merge map of project names after a run on top of an earlier map."""
    i = project_inputs(spark, sf)
    return merge_map.merge_map(merge_map.pairs(i["known"], i["never"], i["refined"]), i["known"], i["old"])


def task_loads(spark, sf):
    """Eight tasks for each of five owners, matched to parts' names: what they would take
    over, what they share, and what nobody claims."""
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    rows = p.groupBy((k % 5).alias("owner"), "p_brand", "p_name").agg(F.sum(F.col("p_size") / 16.0).alias("mm"), F.min("p_partkey").alias("row"))
    work = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.concat(F.lit("no "), F.reverse("p_name")))
    matches = p.where("p_size > 40").groupBy((k % 5).alias("owner"), (F.col("p_size") % 8).alias("task")).agg(F.array_sort(F.collect_set(work)).alias("works"))
    tasks = matches.select("owner", (F.col("owner") * 100 + F.col("task")).alias("match"), F.concat(F.lit("t"), F.col("task") % 7).alias("task"), "works", (F.col("task") < 7).alias("fit"))
    found = agentic.recalculated(tasks, rows, [F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name")])
    return found.select("owner", "match", "task", F.round("load_mm", 3).alias("load_mm"), F.round("split_mm", 3).alias("split_mm"), "rows", F.array_join("shared", ",").alias("shared"))


def series_labels(spark, sf):
    """Parts' names as projects: aliases lead each fourth name to the next of its kind."""
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    name = F.concat_ws(" ", F.split("p_name", " ")[1], F.when(k % 3 == 0, F.upper(F.split("p_name", " ")[0])).otherwise(F.split("p_name", " ")[0]), (k % 11).cast("string"))
    groups = p.select(name.alias("name"), (k % 9).alias("who"), (F.col("p_size") / 16.0).alias("mm"))
    nth = F.element_at(F.split("name", " "), -1).cast("int")
    aliases = groups.select("name").distinct().where(nth % 4 > 0).select(F.col("name").alias("alias"), F.concat_ws(" ", F.split("name", " ")[0], F.split("name", " ")[1], (nth - 1).cast("string")).alias("canon"))
    found = grouping.series(groups, aliases)
    return found.select("series", "label", F.array_join("names", ",").alias("names"), "persons", "mm")


def scoped_axes(spark, sf):
    """Answers in ten spellings against each brand's entries."""
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    entry = F.concat("p_name", F.lit("/"), F.lower("p_type"), F.when(k % 3 == 0, F.concat(F.lit(" work "), (k % 2).cast("string"))).otherwise(""), F.when(k % 4 == 1, " (new)").when(k % 4 == 2, " (old)").otherwise(""))
    pool = p.select("p_brand", entry.alias("entry"), F.regexp_replace(entry, "^[^/]*/", "").alias("detail")).distinct()
    m = k % 10
    said = (
        F.when(m == 0, F.col("entry")).when(m == 1, F.upper("entry")).when(m == 2, F.replace("entry", F.lit("/"), F.lit(" "))).when(m == 3, F.replace("entry", F.lit(" "), F.lit("  "))).when(m == 4, F.concat("entry", F.lit(" - and more")))
        .when(m == 5, F.concat(F.replace("entry", F.lit(" "), F.lit("")), F.lit(" - and"))).when(m == 6, F.replace("entry", F.lit("/"), F.lit(""))).when(m == 7, F.regexp_replace("entry", r" \(.*$", "")).when(m == 8, F.concat(F.regexp_replace("entry", r"( work.*| \(.*)$", ""), F.lit(".")))
        .otherwise(F.regexp_replace("entry", "^[^/]*/", ""))
    )
    rows = stored(p.select("p_partkey", "p_brand", entry.alias("entry"))).withColumn("said", said).drop("entry")
    return resolve.resolve_scoped(rows, "said", pool, "entry", "p_brand", "detail").select("p_partkey", "p_brand", "said", "resolved", "axis")


def flow_clusters(spark, sf):
    """Orders as flows of nine people: the lines of an order are its steps."""
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    lines = _t(spark, sf, "lineitem").join(p, "l_partkey")
    k = F.col("l_orderkey")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_type"))), lambda s: s["p_type"])
    told = lines.groupBy("l_orderkey").agg(steps.alias("steps"), F.min(F.struct("l_linenumber", "l_partkey", "p_name", "p_brand")).alias("f"), F.sum(F.col("l_quantity") / 100.0).alias("mm"))
    detail = F.when(k % 10 == 0, "").when(k % 3 == 0, F.col("f.p_name")).when(k % 3 == 1, F.concat("f.p_name", F.lit(" check"))).otherwise(F.replace("f.p_name", F.lit(" "), F.lit("_")))
    rows = told.select(k.alias("id"), (k % 2).alias("source"), F.concat(F.lit("o"), k % 9).alias("owner"), "f.p_brand", detail.alias("detail"), F.when(k % 5 == 0, "lead").alias("role"), "steps", F.round("mm", 2).alias("mm"), (k % 3 / 2.0).alias("ax")).withColumnRenamed("p_brand", "project")
    found = flows.flow_summary(rows)
    return found.withColumn("steps", F.array_join("steps", ","))


QUERIES = {f.__name__: f for f in (flow_clusters, scoped_axes, task_loads, series_labels, project_pairs, project_merges, merged_details, similar_names, evidence_rows)}

_PLAIN = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
_FOLD = r"trim(regexp_replace(lower({x}), '[\s_\-./·,]+', ' ', 'g'))"
_DASHLESS = r"trim(regexp_replace({x}, '\s+[-–—]\s+.*$', ''))"
_NOTELESS = r"trim(regexp_replace({x}, '\([^()]*\)\s*$', ''))"


def _axis_keys(x: str) -> list[str]:
    """The keys of what was said, axis by axis."""
    plain, fold = _PLAIN.format(x=x), _FOLD.format(x=x)
    dashless = _DASHLESS.format(x=plain)
    end = f"regexp_replace({plain}, '[. ]+$', '')"
    return [x, f"lower({x})", fold, plain, dashless, f"replace({dashless}, ' ', '')", f"replace({fold}, ' ', '')", _NOTELESS.format(x=dashless), f"CASE WHEN length({end}) >= 8 THEN {end} END", f"replace({fold}, ' ', '')"]


def _entry_keys(x: str, detail: str) -> list[str]:
    own, plain = _axis_keys(x), _PLAIN.format(x=x)
    return [*own[:4], plain, f"replace({plain}, ' ', '')", own[6], own[7], None, f"replace({_FOLD.format(x=detail)}, ' ', '')"]


ORACLE_SQL = {
    "flow_clusters": """WITH RECURSIVE j AS (SELECT l.*, p_name, p_brand, lower(p_type) AS ty FROM lineitem l JOIN part ON l_partkey = p_partkey
), t AS (
  SELECT l_orderkey AS id, list(ty ORDER BY l_linenumber, l_partkey, ty) AS steps, arg_min(p_name, (l_linenumber, l_partkey, p_name, p_brand)) AS n, arg_min(p_brand, (l_linenumber, l_partkey, p_name, p_brand)) AS project, round(sum(l_quantity / 100.0), 2) AS mm FROM j GROUP BY 1
), f AS (
  SELECT *, id % 2 AS source, 'o' || (id % 9) AS owner, CASE WHEN id % 10 = 0 THEN '' WHEN id % 3 = 0 THEN n WHEN id % 3 = 1 THEN n || ' check' ELSE replace(n, ' ', '_') END AS detail, CASE WHEN id % 5 = 0 THEN 'lead' ELSE '' END AS role, id % 3 / 2.0 AS ax FROM t
), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, project, list_sort(list_distinct(steps)), role ORDER BY source, id) AS nth FROM f) WHERE nth = 1
), c AS (SELECT * FROM (SELECT *, bool_or(detail <> '') OVER (PARTITION BY owner, project) AS finer FROM o) WHERE detail <> ''
), g AS (SELECT *, replace(replace(detail, ' ', ''), '_', '') AS key, row_number() OVER (PARTITION BY project ORDER BY id) AS i FROM c
), h AS (SELECT *, list_distinct(list_transform(range(1, length(key)), lambda x: key[x:x + 1])) AS grams FROM g
), w(project, i, id, slot, held) AS (
  SELECT project, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::STRUCT(id BIGINT, detail VARCHAR, key VARCHAR, grams VARCHAR[], steps VARCHAR[])[] FROM (SELECT DISTINCT project FROM h)
  UNION ALL
  SELECT project, i, id, coalesce(slot, len(held) + 1), CASE WHEN slot IS NULL THEN list_append(held, {'id': id, 'detail': detail, 'key': key, 'grams': grams, 'steps': list_distinct(steps)}) ELSE
    list_concat(list_append(held[:slot - 1], {'id': held[slot].id, 'detail': CASE WHEN longer THEN detail ELSE held[slot].detail END, 'key': CASE WHEN longer THEN key ELSE held[slot].key END, 'grams': CASE WHEN longer THEN grams ELSE held[slot].grams END,
      'steps': list_distinct(list_concat(held[slot].steps, steps))}), held[slot + 1:]) END
  FROM (SELECT *, length(detail) > length(held[slot].detail) OR (length(detail) = length(held[slot].detail) AND detail > held[slot].detail) AS longer FROM (
    SELECT h.*, w.held, list_position(list_transform(w.held, lambda x: x.key = h.key OR 2.0 * len(list_intersect(x.grams, h.grams)) / (len(x.grams) + len(h.grams)) >= 0.75 OR (len(list_distinct(h.steps)) >= 3 AND len(x.steps) >= 3
      AND 2.0 * len(list_intersect(x.grams, h.grams)) / (len(x.grams) + len(h.grams)) >= 0.4 AND len(list_intersect(x.steps, h.steps)) >= 0.6 * len(list_distinct(list_concat(x.steps, h.steps))))), true) AS slot
    FROM w JOIN h ON h.project = w.project AND h.i = w.i + 1))
), e AS (SELECT project, arg_max(held, i) AS held FROM w GROUP BY project
), m AS (SELECT h.*, e.held[w.slot].id AS cluster, e.held[w.slot].detail AS label FROM w JOIN h ON h.project = w.project AND h.id = w.id JOIN e ON e.project = w.project
), s AS (SELECT cluster, any_value(project) AS project, any_value(label) AS label, count(DISTINCT owner) AS people, count(*) AS flows, sum(mm) AS mm, sum(mm * ax) AS ax_mm, avg(ax) AS ax_mean FROM m GROUP BY cluster
), x AS (SELECT cluster, unnest(steps) AS step, unnest(range(len(steps))) AS place FROM m
), y AS (SELECT cluster, step, count(*) AS n, avg(place) AS place, any_value(flows) AS flows FROM x JOIN s USING (cluster) GROUP BY 1, 2
), z AS (SELECT *, bool_or(n * 2 >= flows) OVER (PARTITION BY cluster) AS any_, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, step) AS rank FROM y
), k AS (SELECT cluster, list(step ORDER BY place, step) AS list FROM z WHERE CASE WHEN any_ THEN n * 2 >= flows ELSE rank <= 7 END GROUP BY 1)
SELECT cluster, project, label, people, flows, round(mm, 3)::DOUBLE AS mm, round(CASE WHEN mm > 0 THEN ax_mm / mm ELSE ax_mean END, 4)::DOUBLE AS ax, array_to_string(list[:10], ',') AS steps, len(list)::INTEGER AS total FROM s JOIN k USING (cluster)""",
    "scoped_axes": rf"""WITH e AS (
  SELECT *, p_name || '/' || lower(p_type) || CASE WHEN p_partkey % 3 = 0 THEN ' work ' || (p_partkey % 2) ELSE '' END || CASE p_partkey % 4 WHEN 1 THEN ' (new)' WHEN 2 THEN ' (old)' ELSE '' END AS entry FROM part
), a AS (
  SELECT p_partkey, p_brand, CASE p_partkey % 10 WHEN 0 THEN entry WHEN 1 THEN upper(entry) WHEN 2 THEN replace(entry, '/', ' ') WHEN 3 THEN replace(entry, ' ', '  ') WHEN 4 THEN entry || ' - and more' WHEN 5 THEN replace(entry, ' ', '') || ' - and' WHEN 6 THEN replace(entry, '/', '')
    WHEN 7 THEN regexp_replace(entry, ' \(.*$', '') WHEN 8 THEN regexp_replace(entry, '( work.*| \(.*)$', '') || '.' ELSE regexp_replace(entry, '^[^/]*/', '') END AS said FROM e
), d AS (SELECT DISTINCT p_brand, entry, regexp_replace(entry, '^[^/]*/', '') AS detail FROM e
), pf AS (SELECT p_brand, entry, {_PLAIN.format(x='entry')} AS t, unnest(range(8, 80)) AS n FROM d
), k AS (
  {' UNION '.join(f"SELECT p_brand, entry, {i} AS i, {key} AS key FROM d" for i, key in enumerate(_entry_keys('entry', 'detail')) if key)}
  UNION SELECT p_brand, entry, 8, t[1:n] FROM pf WHERE n = length(t) OR (n < length(t) AND NOT regexp_matches(t[n + 1], '[\p{{L}}\p{{N}}]'))
), u AS (SELECT p_brand, i, key, min(entry) AS entry FROM k WHERE key <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT entry) = 1
), q AS ({' UNION ALL '.join(f"SELECT p_partkey, p_brand, said, {i} AS i, {key} AS key FROM a" for i, key in enumerate(_axis_keys('said')))}
), h AS (
  SELECT p_partkey, arg_min(entry, i) AS resolved, min(i) AS i FROM q JOIN u USING (p_brand, i, key)
  WHERE i <> 7 OR regexp_extract(said, '\(([^()]*)\)\s*$', 1) = '' OR lower(regexp_extract(said, '\(([^()]*)\)\s*$', 1)) = regexp_extract(entry, '\(([^()]*)\)\s*$', 1) GROUP BY p_partkey
) SELECT p_partkey, p_brand, said, resolved, ['exact', 'lower', 'fold', 'plain', 'dashless', 'dashless joined', 'key', 'noteless', 'prefix', 'detail'][h.i + 1] AS axis FROM a LEFT JOIN h USING (p_partkey)""",
    "task_loads": """WITH r AS (SELECT p_partkey % 5 AS owner, p_brand AS brand, p_name AS n, sum(p_size / 16.0) AS mm, min(p_partkey) AS row FROM part GROUP BY 1, 2, 3
), m AS (
  SELECT p_partkey % 5 AS owner, p_size % 8 AS task, list(DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || p_name ELSE 'no ' || reverse(p_name) END) AS works FROM part WHERE p_size > 40 GROUP BY 1, 2
), t AS (SELECT owner, owner * 100 + task AS match, 't' || (task % 7) AS task, task < 7 AS fit, works FROM m
), w AS (SELECT owner, match, task, replace(lower(unnest(works)), ' ', '') AS k FROM t WHERE fit
), x AS (SELECT owner, row, unnest([replace(lower(n), ' ', ''), replace(lower(brand || ' ' || n), ' ', '')]) AS k FROM r
), h AS (SELECT w.owner, match, task, w.k, row, w.k = x.k AS same FROM w JOIN x ON w.owner = x.owner AND (w.k = x.k OR contains(w.k, x.k) OR contains(x.k, w.k))
), c AS (SELECT DISTINCT owner, match, task, row FROM (SELECT *, bool_or(same) OVER (PARTITION BY owner, k) AS any_same FROM h) WHERE same OR NOT any_same
), n AS (SELECT c.*, mm, count(*) OVER (PARTITION BY c.owner, c.row) AS claimed FROM c JOIN r ON r.owner = c.owner AND r.row = c.row
), s AS (SELECT a.owner, a.match, list_sort(list(DISTINCT b.task)) AS shared FROM n a JOIN n b ON a.owner = b.owner AND a.row = b.row AND a.task <> b.task GROUP BY 1, 2
), g AS (SELECT owner, match, sum(mm) AS load_mm, sum(mm / claimed) AS split_mm, count(*) AS rows FROM n GROUP BY 1, 2)
SELECT t.owner, t.match, task, round(coalesce(load_mm, 0), 3)::DOUBLE AS load_mm, round(coalesce(split_mm, 0), 3)::DOUBLE AS split_mm, coalesce(rows, 0) AS rows, coalesce(array_to_string(shared, ','), '') AS shared FROM t LEFT JOIN g ON g.owner = t.owner AND g.match = t.match LEFT JOIN s ON s.owner = t.owner AND s.match = t.match
UNION ALL SELECT owner, NULL, NULL, 0.0, round(sum(mm), 3)::DOUBLE, count(*), '' FROM r ANTI JOIN c USING (owner, row) GROUP BY owner""",
    "series_labels": """WITH RECURSIVE p AS (
  SELECT split_part(p_name, ' ', 2) AS a, CASE WHEN p_partkey % 3 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS b, p_partkey % 11 AS i, p_partkey % 9 AS who, p_size / 16.0 AS mm FROM part
), g AS (SELECT *, a || ' ' || b || ' ' || i AS name FROM p), e AS (SELECT DISTINCT a, b, i, name FROM g
), r AS (SELECT a, b, i, i AS to_ FROM e UNION ALL SELECT r.a, r.b, r.i, r.to_ - 1 FROM r WHERE r.to_ % 4 > 0 AND EXISTS (SELECT 1 FROM e WHERE e.a = r.a AND e.b = r.b AND e.i = r.to_)
), f AS (SELECT a, b, i, lower(a || b) || min(to_) AS series FROM r GROUP BY a, b, i
), s AS (SELECT series, g.* FROM g JOIN f USING (a, b, i)
), l AS (SELECT series, list_sort(list(DISTINCT name)) AS names, min(name) AS first, count(DISTINCT who) AS persons, round(sum(mm), 3)::DOUBLE AS mm, count(DISTINCT lower(a)) AS na, count(DISTINCT lower(b)) AS nb, count(DISTINCT i) AS ni FROM s GROUP BY series)
SELECT series, CASE WHEN len(names) < 2 THEN first WHEN na = 1 THEN array_to_string(string_split(first, ' ')[1:CASE WHEN nb = 1 THEN CASE WHEN ni = 1 THEN 3 ELSE 2 END ELSE 1 END], ' ') || ' series' ELSE first END AS label, array_to_string(names, ',') AS names, persons, mm FROM l""",
    "project_pairs": r"""WITH r AS (
  SELECT p_partkey % 5 AS owner, CASE WHEN p_partkey % 6 < 3 THEN p_name WHEN p_partkey % 6 = 3 THEN replace(p_name, ' ', '-') WHEN p_partkey % 6 = 4 THEN p_name || ' (new)' ELSE p_name || ' ' || (p_partkey % 2 + 1) END AS name,
    p_size / 8.0 AS mm, replace(lower(p_type), ' ', '') || (p_size % 7) AS detail, CASE WHEN p_partkey % 40 = 0 THEN lower(p_brand) END AS product, DATE '2024-01-01' + CAST(p_partkey % 120 AS INTEGER) AS day FROM part
), pin AS (SELECT DISTINCT lower(c_mktsegment) AS k FROM customer UNION SELECT DISTINCT replace(p_name, ' ', '') FROM part WHERE p_size = 50
), n AS (
  SELECT owner, name, list_sort(list(DISTINCT detail)) AS details, list_sort(list(DISTINCT product) FILTER (product IS NOT NULL)) AS products, min(day) AS d0, max(day) AS d1, regexp_replace(lower(name), '[\s_\-./·,]+', '', 'g') AS key,
    regexp_extract(name, '\(([^()]*)\)\s*$', 1) AS note, list_sort(list_distinct(regexp_extract_all(name, '\d+'))) AS nums, list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '\d'))) AS toks FROM r GROUP BY owner, name
), m AS (SELECT *, list_distinct(list_transform(range(1, length(key)), lambda j: key[j:j + 1])) AS grams, key IN (SELECT k FROM pin) AS pinned, greatest(14, date_diff('day', min(d0) OVER (PARTITION BY owner), max(d1) OVER (PARTITION BY owner)) // 2) AS half FROM n
), nv AS (SELECT DISTINCT least(a, b) AS k1, greatest(a, b) AS k2 FROM (SELECT replace(p_name, ' ', '') AS a, replace(p_name, ' ', 's') AS b FROM part WHERE p_size = 1)
), rf AS (SELECT DISTINCT owner, l[1] AS a, l[2] AS b FROM (SELECT owner, day, list_sort(list(DISTINCT name)) AS l FROM r WHERE mm > 6 GROUP BY 1, 2) WHERE len(l) = 2
), j AS (
  SELECT x.owner, x.name AS a, y.name AS b, 2.0 * len(list_intersect(x.grams, y.grams)) / (len(x.grams) + len(y.grams)) AS dice, len(list_intersect(x.details, y.details)) / (len(x.details) + len(y.details) - len(list_intersect(x.details, y.details)))::DOUBLE AS jac,
    len(list_intersect(coalesce(x.products, []), coalesce(y.products, []))) > 0 AS prod, rf.a IS NOT NULL AS refined, nv.k1 IS NOT NULL AS never, x.key = y.key AS same, x.note <> y.note OR x.nums <> y.nums AS other, x.pinned AND y.pinned AS pins,
    len(x.details) >= 2 AND len(y.details) >= 2 AS many, len(list_intersect(x.toks, y.toks)) IN (len(x.toks), len(y.toks)) AND abs(len(x.toks) - len(y.toks)) >= 2 AS subset, date_diff('day', least(x.d1, y.d1), greatest(x.d0, y.d0)) >= x.half AS apart
  FROM m x JOIN m y ON x.owner = y.owner AND x.name < y.name LEFT JOIN nv ON nv.k1 = least(x.key, y.key) AND nv.k2 = greatest(x.key, y.key) LEFT JOIN rf ON rf.owner = x.owner AND rf.a = x.name AND rf.b = y.name
), s AS (
  SELECT owner, a, b, CASE WHEN never OR other THEN '-Infinity'::DOUBLE WHEN same THEN 10.0 WHEN pins THEN '-Infinity'::DOUBLE ELSE round(CASE WHEN dice > 0.45 THEN 2.4 * (dice - 0.45) ELSE 0 END + CASE WHEN jac > 0 THEN 2 * jac WHEN many THEN -0.8 ELSE 0 END
    + CASE WHEN refined THEN 1.0 ELSE 0 END + CASE WHEN prod THEN 1.2 ELSE 0 END - CASE WHEN subset THEN 0.5 ELSE 0 END - CASE WHEN apart THEN 0.6 ELSE 0 END, 6) END AS score FROM j WHERE dice > 0.45 OR jac >= 0.175 OR prod OR refined OR same
)
SELECT *, CASE WHEN score = '-Infinity'::DOUBLE THEN 'veto' WHEN score >= 1 THEN 'merge' WHEN score >= 0.35 THEN 'ask' ELSE 'apart' END AS band FROM s""",
    "merged_details": rf"""WITH RECURSIVE p AS ({_PART}), r AS (SELECT brand, size, {_DETAIL} AS detail FROM p
), s AS (SELECT brand, detail, sum(size)::BIGINT AS size, bool_or(size = 50) AS fixed FROM r GROUP BY 1, 2
), o AS (
  SELECT *, list_filter(list_distinct(regexp_split_to_array(detail, '[\s_\-·/()\[\],]+')), lambda w: length(w) >= 2 AND w NOT IN ('work', 'task', 'misc', 'support', 'and', 'for')) AS words,
    regexp_extract(detail, '\(([^()]*)\)\s*$', 1) AS note, row_number() OVER (PARTITION BY brand ORDER BY NOT fixed, -size, detail) AS i FROM s
), w(brand, i, reps, detail, size, canon) AS (
  SELECT brand, 0::BIGINT, []::STRUCT(n VARCHAR, w VARCHAR[], note VARCHAR)[], NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT brand FROM o)
  UNION ALL
  SELECT brand, i, CASE WHEN hit IS NULL THEN list_append(reps, {{'n': detail, 'w': words, 'note': note}}) ELSE reps END, detail, size, coalesce(hit, detail) FROM (
    SELECT o.brand, o.i, w.reps, o.detail, o.size, o.words, o.note, CASE WHEN NOT o.fixed THEN list_filter(w.reps, lambda r: len(o.words) > 0 AND len(r.w) > 0 AND r.note = o.note AND
      (len(list_intersect(o.words, r.w)) >= 2 OR len(list_intersect(o.words, r.w)) = len(o.words) OR len(list_intersect(o.words, r.w)) = len(r.w)))[1].n END AS hit
    FROM w JOIN o ON o.brand = w.brand AND o.i = w.i + 1)
) SELECT brand AS p_brand, detail, size AS p_size, canon FROM w WHERE i > 0""",
    "similar_names": rf"""WITH RECURSIVE p AS ({_PART}), r AS (
  SELECT CASE k % 5 WHEN 0 THEN n WHEN 1 THEN n || ' ' || ty WHEN 2 THEN replace(n, ' ', '_') WHEN 3 THEN n || ' ' || ty || 's' ELSE upper(f[1]) || f[2:] || ' ' || upper(l[1]) || l[2:] || ' (x)' END AS name, min(k) AS k FROM p GROUP BY 1
), o AS (
  SELECT name, lower(regexp_replace(name, '[\s_\-./·,]+', '', 'g')) AS key, regexp_extract(name, '\(([^()]*)\)\s*$', 1) AS note, row_number() OVER (ORDER BY k, name) AS i FROM r
), g AS (SELECT *, list_distinct(list_transform(range(1, length(key)), lambda j: key[j:j + 1])) AS grams FROM o
), w(i, slot, name, held) AS (
  SELECT 0::BIGINT, 0::BIGINT, NULL::VARCHAR, []::STRUCT(name VARCHAR, key VARCHAR, note VARCHAR, grams VARCHAR[])[]
  UNION ALL
  SELECT i, coalesce(slot, len(held) + 1), name, CASE WHEN slot IS NULL THEN list_append(held, {{'name': name, 'key': key, 'note': note, 'grams': grams}})
    WHEN length(name) > length(held[slot].name) OR (length(name) = length(held[slot].name) AND name > held[slot].name) THEN list_concat(list_append(held[:slot - 1], {{'name': name, 'key': key, 'note': note, 'grams': grams}}), held[slot + 1:]) ELSE held END
  FROM (SELECT g.*, w.held, list_position(list_transform(w.held, lambda x: x.key = g.key OR (x.note = g.note AND 2.0 * len(list_intersect(x.grams, g.grams)) / (len(x.grams) + len(g.grams)) >= 0.8)), true) AS slot FROM w JOIN g ON g.i = w.i + 1)
), final AS (SELECT held FROM w ORDER BY i DESC LIMIT 1)
SELECT name, (SELECT held FROM final)[slot].name AS label FROM w WHERE i > 0""",
    "evidence_rows": rf"""WITH p AS ({_PART}), a AS (
  SELECT DISTINCT CASE k % 6 WHEN 0 THEN brand || ' ' || n WHEN 1 THEN upper(replace(n, ' ', '_')) WHEN 2 THEN replace(n, ' ', '') WHEN 3 THEN substr(n, 2, length(n) - 2) WHEN 4 THEN 're' || n || ty ELSE 'abc' END AS asked FROM p
), r AS (SELECT brand, n, min(k) AS row FROM p GROUP BY 1, 2
), x AS (SELECT DISTINCT row, unnest([lower(n), lower(brand || ' ' || n)]) AS key FROM r
), q AS (SELECT asked, trim(regexp_replace(lower(asked), '[\s_\-./·,]+', ' ', 'g')) AS key FROM a
), h AS (
  SELECT DISTINCT asked, row, CASE WHEN q.key = x.key THEN 1 WHEN replace(q.key, ' ', '') = replace(x.key, ' ', '') THEN 2 ELSE 3 END AS level FROM q JOIN x
    ON q.key = x.key OR replace(q.key, ' ', '') = replace(x.key, ' ', '') OR (length(replace(q.key, ' ', '')) >= 4 AND length(replace(x.key, ' ', '')) >= 4 AND (contains(replace(x.key, ' ', ''), replace(q.key, ' ', '')) OR contains(replace(q.key, ' ', ''), replace(x.key, ' ', ''))))
), b AS (SELECT asked, min(level) AS best FROM h GROUP BY 1)
SELECT DISTINCT asked, row, ['exact', 'joined', 'inside'][level] AS how FROM h JOIN b USING (asked) WHERE level = best""",
}
