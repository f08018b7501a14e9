"""DuckDB SQL for the registered queries, written apart from their Spark plans."""

from __future__ import annotations

_SIG = """sig AS (
  SELECT user_id AS owner, ts, CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute, event_type AS source,
    CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'file' ELSE 'mail' END AS family,
    CASE event_type WHEN 'purchase' THEN 4.0::DOUBLE WHEN 'signup' THEN 3.0 WHEN 'click' THEN 1.5 WHEN 'view' THEN 0.4 ELSE 0.25 END AS weight,
    CASE event_type WHEN 'purchase' THEN 90.0::DOUBLE WHEN 'signup' THEN 60.0 WHEN 'click' THEN 20.0 WHEN 'view' THEN 5.0 ELSE 3.0 END AS width,
    event_type IN ('purchase', 'signup', 'click') AS active
  FROM events
)"""
_LONE = f"""{_SIG}, lone AS (
  SELECT owner, day, source, active, greatest(minute - greatest(2.5::DOUBLE, width / 2), 0.0::DOUBLE) AS a, least(minute + greatest(2.5::DOUBLE, width / 2), 1440.0::DOUBLE) AS b FROM sig
)"""


def _islands(source: str, name: str = "isl", keys: str = "owner, day") -> str:
    """Maximal spans of a span table, as two more CTEs."""
    return f"""{name}_m AS (
  SELECT {keys}, a, b, max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE a < b
), {name}_g AS (
  SELECT {keys}, a, b, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM {name}_m
), {name} AS (SELECT {keys}, min(a) AS a, max(b) AS b FROM {name}_g GROUP BY {keys}, g)"""


def _minutes_of_pairs(keep: str) -> str:
    """Minutes with (not) both purchase and signup cover, on half-minute ticks:
    every boundary is a multiple of half a minute."""
    return f"""WITH {_LONE}, ticks AS (
  SELECT owner, day, source, CAST(UNNEST(range(CAST(a * 2 AS BIGINT), CAST(b * 2 AS BIGINT))) AS BIGINT) AS k FROM lone WHERE source IN ('purchase', 'signup')
), marked AS (
  SELECT owner, day, k, bool_or(source = 'purchase') AS p, bool_or(source = 'signup') AS q FROM ticks GROUP BY ALL
), kept AS (SELECT owner, day, k, k - row_number() OVER (PARTITION BY owner, day ORDER BY k) AS g FROM marked WHERE {keep})
SELECT owner, day, round(count(*) / 2.0, 2)::DOUBLE AS minutes, count(DISTINCT g) AS pieces FROM kept GROUP BY owner, day"""


#: Hours of spans that end on half minutes, rounded half up in whole numbers.
_HOURS = "((CAST(sum(b - a) * 2 AS BIGINT) * 100 + 60) // 120) / 100.0::DOUBLE"

_LP = "lineitem JOIN part ON l_partkey = p_partkey"
_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '^\\s*(?:(?:re|fw|fwd|aw|wg)\\s*:\\s*)+', '', 'i')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND length(w) <= 24 AND NOT regexp_matches(w, '[0-9]')))"
_KEY = "regexp_replace(trim(regexp_replace(lower({0}), '[\\s_\\-./·,]+', ' ', 'g')), ' ', '', 'g')"
_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"

ORACLE_SQL = {
    "signal_weighted_grid": f"WITH {_SIG} SELECT owner, source, round(sum(weight), 4) AS weight, count(*) AS signals, count(DISTINCT family) AS families, count(DISTINCT day) AS days FROM sig GROUP BY owner, source",
    "confidence_grade": f"""WITH {_SIG}, c AS (SELECT owner, count(DISTINCT family) AS families, count(DISTINCT day) AS days FROM sig GROUP BY owner)
SELECT owner, families, days, CASE WHEN families >= 2 AND days >= 3 THEN 'high' WHEN families >= 2 OR days >= 3 THEN 'mid' ELSE 'low' END AS confidence FROM c""",
    "share_allocation": f"""WITH c AS (SELECT l_suppkey AS owner, p_brand AS project, sum(l_quantity) AS weight FROM {_LP} GROUP BY 1, 2),
s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY owner) AS raw, row_number() OVER (PARTITION BY owner ORDER BY weight DESC, project) AS rn FROM c),
m AS (SELECT *, round(raw * 3.0, 3) AS mm0 FROM s),
r AS (SELECT *, round(3.0 - sum(mm0) OVER (PARTITION BY owner), 3) AS rest FROM m)
SELECT owner, project, weight, round(raw, 4) AS share, CASE WHEN rn = 1 AND abs(rest) >= 0.0005 THEN greatest(0.0, round(mm0 + rest, 3)) ELSE mm0 END AS mm FROM r""",
    "strongest_signal": "SELECT user_id AS owner, CAST(ts AS DATE) AS day, event_type, first(event_id ORDER BY value DESC, event_id) AS event_id, max(value) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "mm_rescale": """WITH r AS (SELECT l_suppkey AS owner, l_returnflag AS project, sum(l_quantity) AS mm FROM lineitem GROUP BY 1, 2),
f AS (SELECT r.*, CASE WHEN sum(mm) OVER (PARTITION BY owner) > 0 AND s_acctbal > 0 THEN s_acctbal / sum(mm) OVER (PARTITION BY owner) ELSE 1.0 END AS factor FROM r JOIN supplier ON owner = s_suppkey)
SELECT owner, project, mm, round(factor, 6) AS factor, round(mm * factor, 3) AS scaled FROM f""",
    "prorata_allocation": """WITH r AS (SELECT l_suppkey AS owner, l_linestatus AS status, l_returnflag AS project, sum(l_quantity) AS mm FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT *, coalesce(sum(mm) FILTER (project = 'N') OVER (PARTITION BY owner), 0) AS loose, coalesce(sum(mm) FILTER (project <> 'N') OVER (PARTITION BY owner), 0) AS firm FROM r)
SELECT owner, status, project, mm, round(CASE WHEN project = 'N' THEN CASE WHEN firm > 0 THEN 0.0 ELSE mm END ELSE mm + loose * mm / firm END, 3) AS spread FROM w""",
    "coverage_grade": f"""WITH {_SIG}, d AS (SELECT owner, count(DISTINCT day) AS days, count(DISTINCT source) AS sources, max((source = 'purchase')::INT) AS bought FROM sig GROUP BY owner)
SELECT owner, days, sources, CASE (days < 20)::INT + (sources < 5)::INT + (bought = 0)::INT WHEN 0 THEN 'reliable' WHEN 1 THEN 'caution' ELSE 'unreliable' END AS grade FROM d""",
    "rehours_difference": f"""WITH {_LONE}, strong AS (SELECT * FROM lone WHERE active), {_islands('lone', 'x')}, {_islands('strong', 'y')},
hx AS (SELECT owner, day, {_HOURS} AS h FROM x GROUP BY 1, 2), hy AS (SELECT owner, day, {_HOURS} AS h FROM y GROUP BY 1, 2),
bx AS (SELECT owner, round(sum(h), 2) AS h FROM hx GROUP BY 1), bz AS (SELECT owner, round(sum(h), 2) AS h FROM hy GROUP BY 1)
SELECT owner, coalesce(bx.h, 0.0) AS before, coalesce(bz.h, 0.0) AS after, round(coalesce(bx.h, 0.0) - coalesce(bz.h, 0.0), 2) AS dropped FROM bx FULL JOIN bz USING (owner)""",
    "interval_union_hours": f"WITH {_LONE}, {_islands('lone')} SELECT owner, day, {_HOURS} AS hours, count(*) AS islands FROM isl GROUP BY 1, 2",
    "interval_intersect_minutes": _minutes_of_pairs("p AND q"),
    "interval_subtract_minutes": _minutes_of_pairs("p AND NOT q"),
    "interval_clip_day": f"""WITH {_LONE}, c AS (SELECT owner, day, greatest(a, 480.0::DOUBLE) AS a, least(b, 1140.0::DOUBLE) AS b FROM lone), {_islands('c')}
SELECT owner, day, {_HOURS} AS hours, count(*) AS islands FROM isl GROUP BY 1, 2""",
    "interval_tail": f"""WITH {_LONE}, {_islands('lone')}, r AS (SELECT *, 60.0 - coalesce(sum(b - a) OVER (PARTITION BY owner, day ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS room FROM isl),
k AS (SELECT owner, day, greatest(a, b - room) AS a, b FROM r WHERE room > 0)
SELECT owner, day, round(sum(b - a), 2) AS minutes, round(min(a), 2) AS starts FROM k GROUP BY 1, 2""",
    "fit_credit": f"""WITH {_LONE}, {_islands('lone')}, e AS (SELECT owner, day, greatest(a, 1140.0) AS a, b FROM isl WHERE b > 1140.0)
SELECT owner, day, round(least(sum(b - a), 120.0), 2) AS minutes FROM e WHERE a < b GROUP BY 1, 2""",
    "day_night_split": f"""WITH {_LONE}, {_islands('lone')}
SELECT owner, day, round(sum(greatest(0.0, least(b, 1140.0) - greatest(a, 480.0))), 2) AS day_min, round(sum(b - a - greatest(0.0, least(b, 1140.0) - greatest(a, 480.0))), 2) AS night_min FROM isl GROUP BY 1, 2""",
    "midnight_split": """WITH s AS (SELECT ts, ts + INTERVAL 30 HOURS AS until FROM events WHERE event_type = 'purchase'),
d AS (SELECT ts, until, UNNEST(generate_series(date_trunc('day', ts), until - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS d0 FROM s)
SELECT CAST(d0 AS DATE) AS day, count(*) AS pieces, round(sum((epoch_us(least(until, d0 + INTERVAL 1 DAY)) - epoch_us(greatest(ts, d0))) / 60e6), 1) AS minutes FROM d GROUP BY 1""",
    "trace_window": f"WITH {_SIG} SELECT owner, day, greatest(min(minute) - 30.0, 0.0)::DOUBLE AS a, least(max(minute) + 30.0, 1440.0)::DOUBLE AS b FROM sig GROUP BY 1, 2",
    "edge_trim": f"""WITH {_SIG}, f AS (SELECT owner, day, min(minute)::DOUBLE AS lo, max(minute)::DOUBLE AS hi FROM sig GROUP BY 1, 2),
k AS (SELECT owner, day, greatest(480.0, least(lo, 490.0))::DOUBLE AS a, least(1140.0, greatest(hi, 1130.0))::DOUBLE AS b FROM f) SELECT * FROM k WHERE a < b""",
    "minute_clusters": f"""WITH {_SIG}, h AS (SELECT DISTINCT source, day, hour(ts) AS h FROM sig),
n AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY source, day ORDER BY h) <= 2 THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT *, sum(new) OVER (PARTITION BY source, day ORDER BY h) AS g FROM n)
SELECT source, day, CAST(min(h) AS INTEGER) AS first, CAST(max(h) AS INTEGER) AS last, count(*) AS n FROM g GROUP BY source, day, g""",
    "burst_minutes": f"""WITH {_SIG}, c AS (SELECT source, day, hour(ts) AS h, count(*) AS n FROM sig GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY source, day ORDER BY h RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM c)
SELECT source, day, CAST(h AS INTEGER) AS hour, n, CAST(near AS BIGINT) AS near FROM w WHERE near >= 8""",
    "session_gap_30": """WITH g AS (SELECT user_id AS owner, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY owner ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
v AS (SELECT owner, s, count(*) AS points, (epoch_us(max(ts)) - epoch_us(min(ts)) + 300000000) // 1000000 AS seconds FROM s GROUP BY 1, 2)
SELECT owner, count(*) AS visits, CAST(sum(points) AS BIGINT) AS points, CAST(sum(seconds) AS BIGINT) AS seconds FROM v GROUP BY 1""",
    "session_active_passive": f"""WITH RECURSIVE {_SIG}, used AS (
  SELECT owner, day, minute - greatest(2.5, width / 2) AS a, minute + greatest(2.5, width / 2) AS b, active, row_number() OVER (PARTITION BY owner, day ORDER BY minute, source) AS n
  FROM sig WHERE active OR (minute >= 480 AND minute < 1140)
), fold AS (
  SELECT owner, day, n, 1 AS s, a, b, active, a AS ca, b AS cb, active AS cact FROM used WHERE n = 1
  UNION ALL
  SELECT u.owner, u.day, u.n,
    CASE WHEN u.a - f.cb <= CASE WHEN u.active AND f.cact THEN 45.0 ELSE 0.0 END THEN f.s ELSE f.s + 1 END,
    u.a, u.b, u.active,
    CASE WHEN u.a - f.cb <= CASE WHEN u.active AND f.cact THEN 45.0 ELSE 0.0 END THEN least(f.ca, u.a) ELSE u.a END,
    CASE WHEN u.a - f.cb <= CASE WHEN u.active AND f.cact THEN 45.0 ELSE 0.0 END THEN greatest(f.cb, u.b) ELSE u.b END,
    CASE WHEN u.a - f.cb <= CASE WHEN u.active AND f.cact THEN 45.0 ELSE 0.0 END THEN f.cact OR u.active ELSE u.active END
  FROM fold f JOIN used u ON u.owner = f.owner AND u.day = f.day AND u.n = f.n + 1
)
SELECT owner, day, greatest(min(a), 0.0)::DOUBLE AS a, least(max(b), 1440.0)::DOUBLE AS b, bool_or(active) AS active FROM fold GROUP BY owner, day, s HAVING greatest(min(a), 0.0) < least(max(b), 1440.0)""",
    "passive_cap": f"""WITH {_LONE}, p AS (SELECT owner, CAST(date_trunc('month', day) AS DATE) AS day, dayofmonth(day) * 1440 + a AS a, dayofmonth(day) * 1440 + b AS b FROM lone WHERE NOT active), {_islands('p')},
c AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY owner, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM isl),
k AS (SELECT owner, day, a, least(b, a + greatest(0.0, 60.0 - before)) AS b FROM c)
SELECT owner, day, round(sum(b - a), 2) AS minutes, count(*) AS spans FROM k WHERE a < b GROUP BY 1, 2""",
    "asof_reply": "SELECT u.conv_id, u.turn, (SELECT min(r.turn) FROM conversations r WHERE r.conv_id = u.conv_id AND r.role = 'assistant' AND r.turn > u.turn) AS reply_turn FROM conversations u WHERE u.role = 'user'",
    "order_done_lead": """WITH p AS (SELECT v.user_id AS owner, v.ts AS o, (SELECT min(d.ts) FROM events d WHERE d.user_id = v.user_id AND d.event_type = 'purchase' AND d.ts > v.ts) AS done_at FROM events v WHERE event_type = 'view')
SELECT owner, done_at, max(o) AS order_at, min(round((epoch_us(done_at) - epoch_us(o)) / 3600e6, 2)) AS lead_h FROM p WHERE epoch_us(done_at) - epoch_us(o) <= 14 * 86400000000 GROUP BY 1, 2""",
    "episode_spans": """WITH d AS (SELECT DISTINCT user_id AS owner, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup'),
n AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY owner ORDER BY day) - 1 > 3 THEN 1 ELSE 0 END AS new FROM d),
g AS (SELECT *, sum(new) OVER (PARTITION BY owner ORDER BY day) + 1 AS episode FROM n)
SELECT owner, CAST(episode AS BIGINT) AS episode, min(day) AS first_day, max(day) AS last_day, count(*) AS active_days FROM g GROUP BY owner, episode""",
    "evidence_gaps": """WITH c AS (SELECT CAST(UNNEST(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
w AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM c WHERE isodow(day) <= 5),
h AS (SELECT DISTINCT user_id AS owner, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
e AS (SELECT owner, min(day) AS lo, max(day) AS hi FROM h GROUP BY 1),
m AS (SELECT e.owner, w.day, w.n FROM e JOIN w ON w.day BETWEEN lo AND hi WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.owner = e.owner AND h.day = w.day)),
i AS (SELECT *, n - row_number() OVER (PARTITION BY owner ORDER BY n) AS g FROM m)
SELECT owner, min(day) AS from_day, max(day) AS to_day, count(*) AS days FROM i GROUP BY owner, g HAVING count(*) >= 3""",
    "power_pairing": """WITH RECURSIVE r AS (
  SELECT user_id AS owner, ts, CASE event_type WHEN 'signup' THEN 'on' WHEN 'click' THEN 'off' WHEN 'error' THEN 'boot' END AS kind FROM events WHERE event_type IN ('signup', 'click', 'error')
), n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts, kind) AS n FROM r), f AS (
  SELECT owner, n, NULL::TIMESTAMP AS s, NULL::TIMESTAMP AS e, CASE WHEN kind = 'off' THEN NULL ELSE ts END AS open FROM n WHERE n = 1
  UNION ALL
  SELECT n.owner, n.n,
    CASE WHEN f.open IS NOT NULL AND (kind = 'off' OR (kind = 'boot' AND (epoch_us(ts) - epoch_us(f.open)) // 1000000 > 1800)) THEN f.open END,
    CASE WHEN f.open IS NOT NULL AND (kind = 'off' OR (kind = 'boot' AND (epoch_us(ts) - epoch_us(f.open)) // 1000000 > 1800)) THEN least(ts, f.open + INTERVAL 20 HOURS) END,
    CASE WHEN kind = 'off' THEN NULL WHEN f.open IS NULL OR (kind = 'boot' AND (epoch_us(ts) - epoch_us(f.open)) // 1000000 > 1800) THEN ts ELSE f.open END
  FROM f JOIN n ON n.owner = f.owner AND n.n = f.n + 1
)
SELECT owner, count(*) AS spans, CAST(sum((epoch_us(e) - epoch_us(s)) // 1000000) AS BIGINT) AS seconds FROM f WHERE s < e GROUP BY 1""",
    "absence_inference": None,
    "sampling_step": """WITH g AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) // 1000000 AS gap FROM events)
SELECT event_type, least(3000.0, greatest(60.0, median(gap)))::DOUBLE AS step_s FROM g WHERE gap > 0 AND gap <= 6000 GROUP BY 1""",
    "even_spread_sample": """WITH r AS (SELECT user_id AS owner, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT owner, event_id FROM r WHERE n <= 8 OR i IN (SELECT CAST(round_even(k * (n - 1) / 7.0, 0) AS BIGINT) FROM range(0, 8) q(k))""",
    "two_level_cap": """WITH g AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS folder, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, least(n, 2) AS take, 6 - coalesce(sum(least(n, 2)) OVER (PARTITION BY day ORDER BY n, folder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM g)
SELECT day, CAST(sum(least(take, room)) AS BIGINT) AS kept FROM s WHERE room > 0 GROUP BY 1""",
    "topk_with_rest": f"""WITH c AS (SELECT l_returnflag, p_brand, sum(l_quantity) AS mm FROM {_LP} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY mm DESC, p_brand) AS n FROM c)
SELECT l_returnflag, CASE WHEN n <= 14 THEN p_brand ELSE '(rest)' END AS p_brand, sum(mm) AS mm, count(*) AS members FROM r GROUP BY 1, 2""",
    "mtime_clumps": """WITH c AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS minute, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, minute) AS k FROM c)
SELECT event_type, minute, n, round(n / total, 4)::DOUBLE AS share FROM r WHERE total >= 20 AND n >= 5 AND k <= 3 AND round(n / total, 4) >= 0.04""",
    "utc_suspect": "SELECT user_id AS owner, count(*) AS n, round(avg((hour(ts) < 8)::INT), 4) AS share FROM events GROUP BY 1 HAVING count(*) >= 5 AND round(avg((hour(ts) < 8)::INT), 4) >= 0.4",
    "oneway_sender": """WITH m AS (SELECT strftime(ts, '%Y%m%d') || '-' || (user_id % 7) || '-' || hour(ts) AS conv, user_id AS sender, event_type = 'purchase' AS sent FROM events),
a AS (SELECT DISTINCT sender FROM m WHERE NOT sent AND conv IN (SELECT conv FROM m WHERE sent))
SELECT sender, count(*) AS n FROM m WHERE NOT sent AND sender NOT IN (SELECT sender FROM a) GROUP BY 1 HAVING count(*) >= 5""",
    "exclude_anti": "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1",
    "alias_left_coalesce": "SELECT coalesce(p_brand, CAST(l_partkey AS VARCHAR)) AS name, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 5 GROUP BY 1",
    "scoped_alias": "SELECT CASE WHEN l_returnflag = 'A' AND s_suppkey IS NOT NULL THEN 'n' || s_nationkey ELSE l_returnflag END AS flag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "program_usage_full_outer": """SELECT user_id, coalesce(f.n, 0) AS front, coalesce(b.n, 0) AS back FROM
(SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) f FULL JOIN
(SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) b USING (user_id)""",
    "pivot_two_way": f"""WITH c AS (SELECT p_brand, p_type, sum(l_quantity) AS value FROM {_LP} GROUP BY 1, 2),
l AS (SELECT 'model' AS side, p_brand AS key, p_type AS other, value FROM c UNION ALL SELECT 'worktype', p_type, p_brand, value FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY side, key ORDER BY value DESC, other) AS INTEGER) AS rank FROM l) SELECT * FROM r WHERE rank <= 10""",
    "common_tasks": f"""SELECT p_name, count(DISTINCT p_brand) AS models, count(DISTINCT l_suppkey) AS people, sum(l_quantity) AS mm, count(DISTINCT l_suppkey) * 10 + sum(l_quantity) AS score
FROM {_LP} GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2 ORDER BY score DESC, p_name LIMIT 15""",
    "team_matrix_pivot": """SELECT s_nationkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS c_A, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS c_N, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS c_R, sum(l_quantity) AS total
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
    "rollup_totals": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "trend_week": """WITH c AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT event_type, CAST(UNNEST(generate_series(min(bucket), max(bucket), INTERVAL 7 DAYS)) AS DATE) AS bucket FROM c GROUP BY 1)
SELECT event_type, bucket, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (event_type, bucket)""",
    "trend_month": """WITH c AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT o_orderpriority, CAST(UNNEST(generate_series(min(bucket), max(bucket), INTERVAL 1 MONTH)) AS DATE) AS bucket FROM c GROUP BY 1)
SELECT o_orderpriority, bucket, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (o_orderpriority, bucket)""",
    "review_topk": """WITH e AS (SELECT strftime(ts, '%Y-%m') AS period, event_type, UNNEST([{'kind': 'user', 'entry': CAST(user_id AS VARCHAR)}, {'kind': 'key', 'entry': json_extract_string(props, '$.k')}, {'kind': 'hour', 'entry': CAST(hour(ts) AS VARCHAR)}]) AS x FROM events),
c AS (SELECT period, event_type, x.kind AS kind, x.entry AS entry, count(*) AS n FROM e WHERE x.entry IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY period, event_type, kind ORDER BY n DESC, entry) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""",
    "cfg_majority": """WITH m AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal > 1500 THEN 'standard' ELSE 'low' END AS signature FROM customer),
c AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, signature) AS n, count(*) OVER (PARTITION BY c_nationkey) AS total FROM m),
j AS (SELECT *, max(CASE WHEN n * 2 > total THEN signature END) OVER (PARTITION BY c_nationkey) AS majority FROM c)
SELECT c_nationkey, c_custkey, signature, majority FROM j WHERE majority IS NOT NULL AND signature <> majority""",
    "headcount_share": "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN 1.0 / count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) ELSE 0.0 END, 6)::DOUBLE AS heads FROM orders",
    "lookup_mode": """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM c) SELECT o_custkey, o_orderpriority, n FROM r WHERE k = 1""",
    "deterministic_majority": """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n, max(o_totalprice) AS w FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, w DESC, o_orderstatus) AS k FROM c) SELECT o_custkey, o_orderstatus, n FROM r WHERE k = 1""",
    "board_by_code_split": """WITH e AS (SELECT UNNEST(list_distinct([l_returnflag, l_linestatus])) AS code, len(list_distinct([l_returnflag, l_linestatus])) AS k, l_quantity AS v, l_discount >= 0.05 AS high FROM lineitem)
SELECT code, count(*) AS n_rows, round(sum(v), 2) AS plan, round(sum(CASE WHEN high THEN v ELSE 0 END), 2) AS high, round(sum(v / k), 2) AS split FROM e GROUP BY 1""",
    "board_validation": """WITH r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS row, * FROM lineitem), i AS (
SELECT row, 'no_discount' AS issue FROM r WHERE l_discount = 0 UNION ALL SELECT row, 'large' FROM r WHERE l_quantity > 45 UNION ALL SELECT row, 'untaxed' FROM r WHERE l_tax = 0 UNION ALL SELECT row, 'cheap' FROM r WHERE l_extendedprice < 2000)
SELECT issue, count(*) AS n, count(DISTINCT row) AS rows FROM i GROUP BY 1""",
    "stored_difference": """WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), c AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT o_custkey, s.v AS stored, c.v AS computed FROM s FULL JOIN c USING (o_custkey) WHERE s.v IS NULL OR c.v IS NULL OR abs(s.v - c.v) > 0.0005""",
    "month_window_gantt": """WITH c AS (SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT max(month) AS top FROM c),
w AS (SELECT c.*, top FROM c, t WHERE month > top - INTERVAL 12 MONTH), s AS (SELECT l_returnflag, CAST(UNNEST(generate_series(min(month), max(top), INTERVAL 1 MONTH)) AS DATE) AS month FROM w GROUP BY 1)
SELECT l_returnflag, month, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (l_returnflag, month)""",
    "candidate_merge": f"SELECT {_KEY.format('p_name')} AS name, sum(l_quantity) AS l_quantity, count(DISTINCT l_suppkey) AS people, first(p_type ORDER BY length(p_type) DESC, p_type DESC) AS p_type FROM {_LP} GROUP BY 1",
    "history_upsert": """WITH k AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 400 DAYS),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM k) SELECT o_orderkey, o_custkey, o_orderdate, round(p, 2) AS o_totalprice FROM r WHERE n <= 2""",
    "exclusion_ledger": """WITH r AS (SELECT CASE WHEN text IS NULL THEN 'null' WHEN length(text) < 40 THEN 'short'
  WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(password|ssn|iban|stupid)([^a-z0-9]|$)') THEN 'private' WHEN contains(lower(text), 'license') THEN 'license' WHEN length(text) > 20000 THEN 'long' END AS reason FROM documents)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "privacy_redaction": """WITH l AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: starts_with(ltrim(x), '#') OR NOT regexp_matches(lower(x), '(^|[^a-z0-9])(stupid|idiot|license)([^a-z0-9]|$)')) AS kept FROM documents)
SELECT doc_id, CAST(length(array_to_string(kept, chr(10))) AS INTEGER) AS n_left, nullif(regexp_extract(lower(text), '(?:^|[^a-z0-9])(stupid|idiot|license)(?:[^a-z0-9]|$)', 1), '') AS hit FROM l""",
    "token_document_frequency": f"WITH w AS (SELECT UNNEST({_TOKENS.format('text')}) AS token FROM documents) SELECT token, count(*) AS df FROM w GROUP BY 1 HAVING count(*) >= 5",
    "project_discovery": f"""WITH r AS (SELECT p_partkey, {_TOKENS.format("p_name || ' ' || p_type")} AS words FROM part), t AS (SELECT p_partkey, UNNEST(words) AS token FROM r),
d AS (SELECT token, count(*) AS df FROM t WHERE length(token) BETWEEN 3 AND 20 GROUP BY 1 HAVING count(*) BETWEEN 2 AND greatest(3, (SELECT count(*) FROM part) // 3)),
b AS (SELECT p_partkey, first(token ORDER BY df DESC, token) AS project FROM t JOIN d USING (token) GROUP BY 1)
SELECT p_partkey, coalesce(project, 'unassigned') AS project FROM part LEFT JOIN b USING (p_partkey)""",
    "project_match": """WITH n AS (SELECT 'P' || n_nationkey AS project, (['red', 'blue', 'ring', 'bolt', 'widget', 'small'])[n_nationkey % 6 + 1] AS needle, n_nationkey AS priority FROM nation),
b AS (SELECT p_partkey, first(project ORDER BY priority, project) AS project FROM part JOIN n ON contains(lower(p_name), needle) GROUP BY 1)
SELECT p_partkey, coalesce(project, 'unassigned') AS project FROM part LEFT JOIN b USING (p_partkey)""",
    "classify_first_match": r"SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '\bring\b') THEN 'ring' WHEN regexp_matches(lower(p_name), 'red|blue') THEN 'coloured' WHEN regexp_matches(lower(p_name), '^small') THEN 'small' ELSE 'other' END AS kind FROM part",
    "longest_prefix_lookup": """WITH p(prefix, label) AS (VALUES ('s', 'any s'), ('small', 'small one'), ('sm', 'sm'), ('eco', 'economy'), ('p', 'p'), ('prom', 'promo')),
m AS (SELECT p_partkey, arg_max(label, length(prefix)) AS label FROM part JOIN p ON starts_with(lower(p_type), prefix) GROUP BY 1) SELECT p_partkey, label FROM part LEFT JOIN m USING (p_partkey)""",
    "bigram_dice_pairs": f"""WITH n AS (SELECT DISTINCT p_name, {_KEY.format('p_name')} AS k FROM part), g AS (SELECT p_name, {_GRAMS.format('k')} AS g FROM n),
d AS (SELECT x.p_name AS a, y.p_name AS b, round(2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)), 4)::DOUBLE AS dice FROM g x JOIN g y ON x.p_name < y.p_name) SELECT a, b, dice FROM d WHERE dice > 0.45""",
    "token_jaccard_pairs": f"""WITH n AS (SELECT DISTINCT p_name, {_KEY.format('p_name')} AS k FROM part), g AS (SELECT p_name, {_GRAMS.format('k')} AS g, {_TOKENS.format('p_name')} AS t FROM n),
d AS (SELECT x.p_name AS a, y.p_name AS b, round(len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))), 4)::DOUBLE AS jaccard FROM g x JOIN g y ON x.p_name < y.p_name AND len(list_intersect(x.g, y.g)) > 0) SELECT a, b, jaccard FROM d WHERE jaccard > 0""",
    "note_number_veto": f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE '' END AS note, CAST(p_size AS VARCHAR) AS numbers, {_KEY.format("(p_name || ' ' || p_size)")} AS key FROM part",
    "text_scalars": r"""WITH n AS (SELECT p_partkey, p_size, replace(p_name, ' ', '_') AS stem, (['.prt.3', '.cas.h5', '.DOCX'])[p_size % 3 + 1] AS tail FROM part)
SELECT p_partkey, lower(stem) || '_v' || p_size AS base, (['prt', 'cas.h5', 'docx'])[p_size % 3 + 1] AS ext,
  CAST(CASE WHEN p_size * 7 % 75 < 60 AND (p_size < 24 OR (p_size = 24 AND p_size * 7 % 75 = 0)) THEN p_size * 60 + p_size * 7 % 75 END AS INTEGER) AS minutes, substr(stem || '_v' || p_size || tail, 1, 40) AS safe FROM n""",
    "json_island": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "page_text": r"""WITH s AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages)
SELECT page_id, CAST(length(trim(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS INTEGER) AS n_chars, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM s""",
    "meeting_rules": """WITH r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_custkey % 6 = 4 THEN 'declined' WHEN o_orderkey % 3 = 0 AND o_custkey % 6 NOT IN (1, 3) THEN 'free' WHEN o_custkey % 6 = 2 AND o_orderkey % 3 = 1 THEN 'tentative' END AS reason FROM orders)
SELECT reason, count(*) AS n FROM r GROUP BY 1""",
    "alias_closure": """WITH RECURSIVE k AS (SELECT c_custkey AS k, c_custkey % 200 // 2 AS r, c_custkey // 200 % 2 = 1 AS plain FROM customer
), s AS (SELECT k, CASE WHEN r < 60 THEN 2 WHEN plain THEN NULL WHEN r < 69 THEN 2 WHEN r < 70 THEN -18 WHEN r < 75 THEN -12 WHEN r < 76 THEN 2 WHEN r < 77 THEN -2 END AS step FROM k
), e AS (SELECT k % 2 AS scope, k, k + step AS n FROM s WHERE step IS NOT NULL
), w AS (SELECT scope, k, n AS cur, [k] AS seen FROM e UNION ALL SELECT w.scope, w.k, e.n, list_append(w.seen, w.cur) FROM w JOIN e ON e.scope = w.scope AND e.k = w.cur WHERE NOT list_contains(w.seen, w.cur)
), l AS (SELECT scope, k, arg_max(cur, len(seen)) AS cur, arg_max(seen, len(seen)) AS seen FROM w GROUP BY 1, 2
), m AS (SELECT scope, k, unnest(CASE WHEN list_contains(seen, cur) THEN seen[list_position(seen, cur):] ELSE [cur] END) AS c FROM l
), x AS (SELECT *, CASE WHEN c % 3 = 0 THEN 'task  ' ELSE 'task ' END || c AS name FROM m
), f AS (SELECT scope, CASE WHEN k % 3 = 0 THEN 'task  ' ELSE 'task ' END || k AS alias, arg_min(name, (length('task ' || c), length(name), name)) AS canon FROM x GROUP BY scope, k)
SELECT * FROM f WHERE alias <> canon""",
}
_SESSIONS = ORACLE_SQL["session_active_passive"].rsplit("SELECT owner, day, greatest(min(a)", 1)[0].rstrip()
_CAPPED = f"""{_SESSIONS}, spans AS (
  SELECT owner, day, greatest(min(a), 0.0)::DOUBLE AS a, least(max(b), 1440.0)::DOUBLE AS b, bool_or(active) AS active FROM fold GROUP BY owner, day, s
), prior AS (
  SELECT *, coalesce(sum(CASE WHEN active THEN 0.0 ELSE b - a END) OVER (PARTITION BY owner, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM spans WHERE a < b
), capped AS (
  SELECT owner, day, a, CASE WHEN active THEN b ELSE least(b, a + greatest(0.0, 60.0 - before)) END AS b FROM prior
), {_islands('capped')}, hours AS (SELECT owner, day, {_HOURS} AS hours FROM isl GROUP BY owner, day)"""
ORACLE_SQL["day_worked_hours"] = f"{_CAPPED} SELECT owner, day, hours FROM hours"
ORACLE_SQL["monthly_load"] = f"""{_CAPPED}, cal AS (SELECT CAST(UNNEST(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY)) AS DATE) AS day),
full_month AS (SELECT date_trunc('month', day) AS m, count(*) FILTER (isodow(day) <= 5) AS workdays FROM cal GROUP BY 1),
w AS (SELECT owner, date_trunc('month', day) AS m, CAST(round(sum(hours) * 100) AS BIGINT) AS c FROM hours WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-03-31' GROUP BY 1, 2)
SELECT owner, strftime(m, '%Y-%m') AS month, ((c + 5) // 10) / 10.0::DOUBLE AS worked_h, CAST(workdays AS INTEGER) AS workdays, 1.0::DOUBLE AS avail_mm,
  ((c * 2000 + 800 * workdays) // (1600 * workdays)) / 1000.0::DOUBLE AS mm, ((c * 2000 + 800 * workdays) // (1600 * workdays)) / 10.0::DOUBLE AS load_pct FROM w JOIN full_month USING (m)"""
ORACLE_SQL["absence_inference"] = f"""{_CAPPED}, cal AS (SELECT CAST(UNNEST(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
m AS (SELECT owner, day, count(*)::DOUBLE AS on_h FROM sig GROUP BY 1, 2), own AS (SELECT DISTINCT owner FROM sig),
f AS (SELECT own.owner, cal.day, coalesce(h.hours, 0.0) AS hours, m.on_h, avg((m.on_h IS NOT NULL)::INT) OVER (PARTITION BY own.owner) AS share
  FROM own CROSS JOIN cal LEFT JOIN hours h ON h.owner = own.owner AND h.day = cal.day LEFT JOIN m ON m.owner = own.owner AND m.day = cal.day WHERE isodow(cal.day) <= 5)
SELECT owner, day FROM f WHERE hours <= 0.25 AND coalesce(on_h, 0.0) <= 0.5 AND share >= 0.4"""
# Minute by minute, in halves: every boundary is a multiple of half a minute.
_H = "((CAST({x} AS BIGINT) * 100 + 60) // 120) / 100.0::DOUBLE"  # ticks to hours, rounded half up
ORACLE_SQL["worked_hours_floor"] = f"""{_CAPPED}, win AS (
  SELECT owner, day, isodow(day) > 5 AS off_day, greatest(min(minute) - 60, 0) * 2 AS wa, least(max(minute) + 60, 1440) * 2 AS wb,
    CASE WHEN bool_or(active) THEN greatest(min(minute) FILTER (active) - 30, 0) * 2 END AS na, CASE WHEN bool_or(active) THEN least(max(minute) FILTER (active) + 30, 1440) * 2 END AS nb,
    coalesce(bool_or(active AND minute + 5 > 720 AND minute - 5 < 780), false) AS lunch_touched, coalesce(bool_or(active AND minute + 5 > 1080 AND minute - 5 < 1110), false) AS dinner_touched
  FROM sig GROUP BY owner, day
), t0 AS (SELECT *, CAST(UNNEST(range(0, 2880)) AS BIGINT) AS k FROM win
), ses AS (SELECT DISTINCT owner, day, CAST(UNNEST(range(CAST(a * 2 AS BIGINT), CAST(b * 2 AS BIGINT))) AS BIGINT) AS k FROM capped WHERE a < b
), t AS (
  SELECT t0.*, k >= wa AND k < wb AS on_, coalesce(k >= na AND k < nb, false) AS near, k >= 960 AND k < 2280 AS dayw, k >= 840 AND k < 2400 AS flex,
    (k >= 1440 AND k < 1560 AND NOT lunch_touched) OR (k >= 2160 AND k < 2220 AND NOT dinner_touched) AS meal,
    ses.k IS NOT NULL AND (NOT off_day OR na IS NOT NULL) AS traced
  FROM t0 LEFT JOIN ses USING (owner, day, k)
), f AS (SELECT *, on_ AND dayw AND NOT meal AND (NOT off_day OR near) AS floored, on_ AND near AND NOT dayw AND NOT traced AS credit FROM t
), s AS (
  SELECT owner, day, any_value(na) IS NOT NULL AS gate, count(*) FILTER (traced AND dayw AND NOT floored) AS rest, count(*) FILTER (traced AND floored) AS inside, count(*) FILTER (floored) AS floor_,
    count(*) FILTER (traced AND NOT dayw) AS tn, count(*) FILTER (on_ AND NOT dayw) AS night_on, count(*) FILTER (credit) AS credit, count(*) FILTER (on_ AND flex AND NOT dayw AND NOT traced AND NOT credit) AS flex_ FROM f GROUP BY owner, day
), n AS (SELECT *, CASE WHEN gate THEN floor_ ELSE 0 END AS fl, tn + least(credit, greatest(0, night_on - tn)) AS c FROM s
), r AS (SELECT *, rest + greatest(inside, fl) AS d, c + CASE WHEN gate THEN least(flex_, greatest(0, night_on - c)) ELSE 0 END AS nn FROM n)
SELECT owner, day, {_H.format(x='least(2880, d + nn)')} AS hours, {_H.format(x='d')} AS day_h, {_H.format(x='nn')} AS night_h, {_H.format(x='fl')} AS floor_h, d + nn > 16 * 120 AS long_day FROM r"""
ORACLE_SQL["cascade_resolution"] = """WITH p AS (SELECT DISTINCT p_name FROM part)
SELECT CASE length(p_name) % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_') ELSE p_name || ' (new)' END AS raw, p_name AS resolved,
  CASE length(p_name) % 3 WHEN 0 THEN 'lower' WHEN 1 THEN 'fold' ELSE 'noteless' END AS axis FROM p"""
