"""Every query of the engine, beside the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import scalars as sc
from .operators import aggregates as ag, callstack as cs, clocks as ck, declarative as de, filters as fi, graphs as gr, kernel as ke, matching as ma, segments as se, states as st
from .plans import as_of, global_lag, global_rank, overlap_join, point_join
from .session import events, micros, table, shared_dir
from .sources import readers as rd

DAY = 86_400_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01
END = T0 + 30 * DAY - 1
HOUR = DAY // 24

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

EV = "ev AS (SELECT event_id AS rank, epoch_us(ts) AS ts, user_id AS tid, user_id % 4 AS cpu, event_type AS type, value, props, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
# Purchases that close a view, by user.
SEG = f"""{EV}, be AS (SELECT *, lag(type) OVER w AS p_type, lag(ts) OVER w AS start FROM ev WHERE type IN ('view', 'purchase') WINDOW w AS (PARTITION BY tid ORDER BY ts, rank)),
seg AS (SELECT tid, start, ts AS "end", rank, 'd' || CAST(start // {DAY} % 7 AS VARCHAR) AS name FROM be WHERE type = 'purchase' AND p_type = 'view')"""
# The type of each user's last event, run-length merged.
IV = f"""{EV}, lw AS (SELECT tid, ts, arg_max(type, rank) AS value FROM ev GROUP BY tid, ts),
ch AS (SELECT *, lag(value) OVER (PARTITION BY tid ORDER BY ts) AS p, row_number() OVER (PARTITION BY tid ORDER BY ts) AS n FROM lw),
iv AS (SELECT tid, ts AS start, coalesce(lead(ts) OVER (PARTITION BY tid ORDER BY ts) - 1, {END}) AS "end", value FROM ch WHERE n = 1 OR value IS DISTINCT FROM p)"""
# The hundredths of each user's last event.
NIV = f"""{EV}, lw AS (SELECT tid, ts, arg_max(cents, rank) AS value FROM ev GROUP BY tid, ts),
ch AS (SELECT *, lag(value) OVER (PARTITION BY tid ORDER BY ts) AS p, row_number() OVER (PARTITION BY tid ORDER BY ts) AS n FROM lw),
iv AS (SELECT tid, ts AS start, coalesce(lead(ts) OVER (PARTITION BY tid ORDER BY ts) - 1, {END}) AS "end", value FROM ch WHERE n = 1 OR value IS DISTINCT FROM p)"""
# Each event as a switch of a CPU to its user.
SW = f"""{EV}, sw AS (SELECT *, lag(tid) OVER (PARTITION BY cpu ORDER BY ts, rank) AS prev FROM ev),
run AS (SELECT cpu, coalesce(prev, 0) AS tid, coalesce(lag(ts) OVER (PARTITION BY cpu ORDER BY ts, rank), {T0}) AS start, ts AS "end" FROM sw
UNION ALL SELECT cpu, tid, ts, {END} FROM (SELECT *, lead(ts) OVER (PARTITION BY cpu ORDER BY ts, rank) AS nx FROM sw) WHERE nx IS NULL)"""


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- shared inputs


def segments(spark, d) -> DataFrame:
    found = se.pair(events(spark, d), ["tid"], F.col("type") == "view", F.col("type") == "purchase")
    return found.select("tid", "start", "end", "rank", F.concat(F.lit("d"), (F.floor(F.col("start") / DAY) % 7).cast("string")).alias("name"))


def type_intervals(spark, d) -> DataFrame:
    return st.intervals(events(spark, d).select("tid", "ts", F.col("rank").alias("seq"), F.col("type").alias("value")), ["tid"], END)


def cents_intervals(spark, d) -> DataFrame:
    return st.intervals(events(spark, d).select("tid", "ts", F.col("rank").alias("seq"), F.col("cents").alias("value")), ["tid"], END)


def switches(spark, d) -> DataFrame:
    e = global_lag(events(spark, d).select("ts", "rank", "cpu", "tid"), "ts", ["ts", "rank"], None, ["tid"], keys=["cpu"])
    return e.select("ts", "rank", "cpu", F.col("tid").alias("next_tid"), F.coalesce("prev_tid", F.lit(0)).alias("prev_tid"))


def run_intervals(spark, d) -> DataFrame:
    return ke.runs(switches(spark, d), T0, END)


# ---------------------------------------------------------------- events, filters, seeks


@query("event_count_by_type", f"WITH {EV} SELECT type, count(*) AS n FROM ev GROUP BY type UNION ALL SELECT NULL, count(*) FROM ev")
def event_count_by_type(spark, d):
    return events(spark, d).rollup("type").agg(F.count("*").alias("n"))


@query("event_histogram", f"""WITH {EV}, g AS (SELECT unnest(range(0, 48)) AS bucket), w AS (SELECT {-(-(30 * DAY) // 48)} AS w)
SELECT g.bucket, {T0} + g.bucket * w.w AS start, count(ev.ts) AS n FROM g CROSS JOIN w LEFT JOIN ev ON ev.ts BETWEEN {T0} AND {END} AND (ev.ts - {T0}) // w.w = g.bucket GROUP BY ALL""")
def event_histogram(spark, d):
    return ag.histogram(events(spark, d), T0, END, 48)


@query("event_histogram_adaptive", f"""WITH {EV}, s AS (SELECT min(ts) AS t0, CAST(pow(2, greatest(0, ceil(log2((max(ts) - min(ts) + 1) / 64.0)))) AS BIGINT) AS width FROM ev)
SELECT (ts - t0) // width AS bucket, width, count(*) AS n FROM ev CROSS JOIN s GROUP BY ALL""")
def event_histogram_adaptive(spark, d):
    return ag.adaptive_histogram(events(spark, d), 64)


@query("events_in_range", f"WITH {EV} SELECT type, count(*) AS n FROM ev WHERE ts BETWEEN {T0 + 3 * DAY} AND {T0 + 9 * DAY} GROUP BY type")
def events_in_range(spark, d):
    return rd.trimmed(events(spark, d), T0 + 3 * DAY, T0 + 9 * DAY).groupBy("type").agg(F.count("*").alias("n"))


@query("lost_event_histogram", f"""WITH {EV}, lost AS (SELECT ts AS start, ts + {HOUR} AS "end", k AS lost FROM ev WHERE type = 'error'), w AS (SELECT {-(-(30 * DAY) // 24)} AS w),
b AS (SELECT lost.*, unnest(range((greatest(start, {T0}) - {T0}) // w, (least("end", {END}) - {T0}) // w + 1)) AS bucket, w FROM lost CROSS JOIN w WHERE start <= {END} AND "end" >= {T0})
SELECT bucket, round(sum(lost * (least("end", {T0} + (bucket + 1) * w - 1) - greatest(start, {T0} + bucket * w) + 1) / ("end" - start + 1)), 4) AS lost FROM b GROUP BY bucket""")
def lost_event_histogram(spark, d):
    lost = events(spark, d).where("type = 'error'").select(F.col("ts").alias("start"), (F.col("ts") + HOUR).alias("end"), F.col("k").alias("lost"))
    return ag.spread_lost(lost, T0, END, 24).select("bucket", F.round("lost", 4).alias("lost"))


@query("filter_dsl_and_or_not", f"WITH {EV} SELECT rank, ts, type FROM ev WHERE (type = 'view' OR NOT (cents > 5000)) AND k IS NOT NULL AND NOT contains(CAST(tid AS VARCHAR), '7')")
def filter_dsl_and_or_not(spark, d):
    return fi.filter_events(events(spark, d), 'type == view || !(cents > 5000) && k present && !(tid contains 7)').select("rank", "ts", "type")


@query("filter_dsl_values", f"WITH {EV} SELECT rank FROM ev WHERE k = 16 OR (regexp_matches(type, '^p.*e$') AND cents < 1000) OR tid > 140")
def filter_dsl_values(spark, d):
    return fi.filter_events(events(spark, d), 'k == 0x10 || (type matches "^p.*e$" && cents < 1000) || tid > 140').select("rank")


@query("filter_tree", f"WITH {EV} SELECT rank, type FROM ev WHERE (upper(type) = 'CLICK' OR type NOT LIKE '%i%') AND NOT (cents < 2000) AND k > 50")
def filter_tree(spark, d):
    e = events(spark, d)
    tree = fi.And([fi.Or([fi.Equals("type", "CLICK", True), fi.Contains("type", "i", negated=True)]), fi.Compare("cents", -1, "2000", negated=True), fi.Compare("k", 1, "50")])
    return e.where(fi.from_json(tree.to_json()).column(fi.resolver(e, "props"))).select("rank", "type")


@query("filter_matches_any_aspect", f"WITH {EV} SELECT rank FROM ev WHERE regexp_matches(type, '^e') OR regexp_matches(props, '^e|\": 9') OR regexp_matches(CAST(tid AS VARCHAR), '^e|\": 9')")
def filter_matches_any_aspect(spark, d):
    e = events(spark, d)
    return e.where(fi.any_regex([F.col("type"), F.col("props"), F.col("tid")], '^e|": 9')).select("rank")


@query("filter_collapse", f"WITH {EV}, p AS (SELECT *, lag(type) OVER (ORDER BY ts, rank) AS q FROM ev) SELECT rank, type FROM p WHERE q IS NULL OR q <> type")
def filter_collapse(spark, d):
    return fi.collapse(events(spark, d), ["type"]).select("rank", "type")


@query("filter_requirements", f"WITH {EV} SELECT level, CASE level WHEN 'MANDATORY' THEN c = 3 WHEN 'OPTIONAL' THEN true WHEN 'AT_LEAST_ONE' THEN c > 0 ELSE c IN (0, 3) END AS ok FROM (SELECT count(DISTINCT type) FILTER (type IN ('view', 'click', 'none')) AS c FROM ev), (VALUES ('MANDATORY'), ('OPTIONAL'), ('AT_LEAST_ONE'), ('ALL_OR_NOTHING')) v(level)")
def filter_requirements(spark, d):
    e = events(spark, d)
    levels = ["MANDATORY", "OPTIONAL", "AT_LEAST_ONE", "ALL_OR_NOTHING"]
    return spark.createDataFrame([(x, fi.requirements(e, ["view", "click", "none"], level=x)) for x in levels], "level string, ok boolean")


@query("search_next_matching", f"WITH {EV} SELECT rank, ts, type FROM ev WHERE rank > 100 AND type = 'error' AND k > 40 ORDER BY rank LIMIT 1")
def search_next_matching(spark, d):
    return fi.next_matching(events(spark, d), 100, (F.col("type") == "error") & (F.col("k") > 40)).select("rank", "ts", "type")


@query("search_previous_matching", f"WITH {EV} SELECT rank, ts, type FROM ev WHERE rank < 900 AND type = 'error' ORDER BY rank DESC LIMIT 1")
def search_previous_matching(spark, d):
    return fi.next_matching(events(spark, d), 900, F.col("type") == "error", backward=True).select("rank", "ts", "type")


@query("event_table_page", f"WITH {EV}, r AS (SELECT rank, ts, type, row_number() OVER (ORDER BY ts, rank) - 1 AS index FROM ev WHERE type <> 'view') SELECT * FROM r WHERE index BETWEEN 200 AND 249")
def event_table_page(spark, d):
    rows = global_rank(events(spark, d).where("type <> 'view'"), "ts", ["ts", "rank"], None)
    return rows.where(F.col("index").between(200, 249)).select("rank", "ts", "type", "index")


@query("seek_by_ratio", f"WITH {EV} SELECT rank FROM ev WHERE rank >= (SELECT CAST(floor((max(rank) - min(rank) + 1) * 0.9 + min(rank)) AS BIGINT) FROM ev)")
def seek_by_ratio(spark, d):
    return rd.from_ratio(events(spark, d), 0.9).select("rank")


@query("seek_by_rank_and_time", f"WITH {EV} SELECT rank, ts FROM ev WHERE rank >= 300 AND ts >= {T0 + 12 * DAY}")
def seek_by_rank_and_time(spark, d):
    return rd.from_time(rd.from_rank(events(spark, d), 300), T0 + 12 * DAY).select("rank", "ts")


@query("experiment_merge", f"""WITH {EV}, m AS (SELECT ts, rank, type, 0 AS trace_index FROM ev WHERE cpu < 2 UNION ALL SELECT ts + 5, rank, type, 1 FROM ev WHERE cpu >= 2)
SELECT *, row_number() OVER (ORDER BY ts, trace_index, rank) - 1 AS index FROM m""")
def experiment_merge(spark, d):
    e = events(spark, d).select("ts", "rank", "type", "cpu")
    merged = rd.experiment(e.where("cpu < 2").drop("cpu"), ck.corrected(e.where("cpu >= 2").withColumn("host", F.lit("b")), {"b": ck.Linear(beta=ck.Fraction(5))}).drop("cpu", "host"))
    return global_rank(merged, "ts", ["ts", "trace_index", "rank"], None)


@query("aspects", f"WITH {EV} SELECT rank, coalesce(CAST(CASE WHEN type = 'click' THEN k END AS VARCHAR), type) AS multi, json_extract_string(props, '$.k') AS field, ts * 1000 AS ts_ns, CASE type WHEN 'view' THEN 'looks' WHEN 'purchase' THEN 'buys' ELSE 'other' END AS label FROM ev")
def aspects(spark, d):
    e = events(spark, d)
    resolve = fi.resolver(e, "props", {"label": sc.lookup("type", {"view": "looks", "purchase": "buys"}, "other")})
    multi = F.coalesce(F.when(F.col("type") == "click", F.col("k")).cast("string"), resolve("type"))
    return e.select("rank", multi.alias("multi"), F.get_json_object("props", "$.k").alias("field"), ck.to_nanoseconds(F.col("ts"), -6).alias("ts_ns"), resolve("label").alias("label"))


@query("event_annotations", f"""WITH {EV} SELECT ts AS start, CAST(0 AS BIGINT) AS duration, type AS label FROM ev WHERE type = 'error' AND k < 10 UNION ALL SELECT ts, {HOUR}, 'lost' FROM ev WHERE type = 'signup' AND k < 5""")
def event_annotations(spark, d):
    e = events(spark, d)
    marks = e.where("type = 'error' and k < 10").select(F.col("ts").alias("start"), F.lit(0).cast("long").alias("duration"), F.col("type").alias("label"))
    return marks.unionByName(e.where("type = 'signup' and k < 5").select(F.col("ts").alias("start"), F.lit(HOUR).cast("long").alias("duration"), F.lit("lost").alias("label")))


# ---------------------------------------------------------------- states


@query("state_intervals", f'WITH {IV} SELECT tid, start, "end", value FROM iv')
def state_intervals(spark, d):
    return type_intervals(spark, d)


@query("state_from_start", f"""WITH {IV} SELECT tid, start, "end", value FROM iv UNION ALL SELECT tid, {T0}, min(start) - 1, NULL FROM iv GROUP BY tid HAVING min(start) > {T0}""")
def state_from_start(spark, d):
    changes = events(spark, d).select("tid", "ts", F.col("rank").alias("seq"), F.col("type").alias("value"))
    return st.intervals(changes, ["tid"], END, start=T0)


@query("state_full_at_time", f'WITH {IV} SELECT tid, value FROM iv WHERE start <= {T0 + 11 * DAY} AND "end" >= {T0 + 11 * DAY}')
def state_full_at_time(spark, d):
    return st.at_time(type_intervals(spark, d), st.check_time(T0 + 11 * DAY, T0, END)).select("tid", "value")


@query("state_single", f'WITH {IV} SELECT tid, start, "end", value FROM iv WHERE tid = 7 AND start <= {T0 + 15 * DAY} AND "end" >= {T0 + 15 * DAY}')
def state_single(spark, d):
    return st.at_time(type_intervals(spark, d).where("tid = 7"), T0 + 15 * DAY)


_TIMES = [T0 + k * DAY for k in (2, 5, 6, 13, 21)]


@query("state_2d_times", f'WITH {IV} SELECT DISTINCT tid, start, "end", value FROM iv JOIN (VALUES {", ".join(f"({t})" for t in _TIMES)}) t(t) ON t.t BETWEEN start AND "end"')
def state_2d_times(spark, d):
    return st.at_times(type_intervals(spark, d), _TIMES)


@query("state_2d_range", f'WITH {IV} SELECT tid, start, "end", value FROM iv WHERE tid IN (3, 5, 8) AND start <= {T0 + 9 * DAY} AND "end" >= {T0 + 4 * DAY}')
def state_2d_range(spark, d):
    return st.in_range(type_intervals(spark, d).where(F.col("tid").isin(3, 5, 8)), T0 + 4 * DAY, T0 + 9 * DAY)


@query("state_history_sampled", f"""WITH {IV}, g AS (SELECT unnest(range({T0 + DAY}, {T0 + 20 * DAY} + 1, {5 * HOUR})) AS t UNION SELECT {T0 + 20 * DAY})
SELECT DISTINCT tid, start, "end", value FROM iv JOIN g ON g.t BETWEEN iv.start AND iv."end" """)
def state_history_sampled(spark, d):
    return st.sampled(type_intervals(spark, d), T0 + DAY, T0 + 20 * DAY, 5 * HOUR)


@query("state_until_non_null", f'WITH {IV}, v AS (SELECT * REPLACE (nullif(value, \'view\') AS value) FROM iv) SELECT tid, start, "end", value FROM v WHERE tid = 9 AND value IS NOT NULL AND start < {T0 + 25 * DAY} AND "end" >= {T0 + 3 * DAY} ORDER BY start LIMIT 1')
def state_until_non_null(spark, d):
    rows = type_intervals(spark, d).where("tid = 9").withColumn("value", F.nullif("value", F.lit("view")))
    return st.until_non_null(rows, T0 + 3 * DAY, T0 + 25 * DAY)


@query("state_increment", f"WITH {EV} SELECT tid, ts, rank, CAST(sum(cents) OVER (PARTITION BY tid ORDER BY ts, rank) AS BIGINT) AS value FROM ev")
def state_increment(spark, d):
    changes = events(spark, d).select("tid", "ts", "rank", F.col("cents").alias("value"))
    return st.increments(changes, ["tid"], ("ts", "rank"))


_OPS = f"""{EV}, ops AS (SELECT *, CASE WHEN type IN ('view', 'click') THEN 1 ELSE -1 END AS s FROM ev WHERE type IN ('view', 'click', 'purchase', 'error')),
run AS (SELECT *, sum(s) OVER (PARTITION BY tid ORDER BY ts, rank) AS t FROM ops),
dep AS (SELECT *, CAST(t - least(0, min(t) OVER (PARTITION BY tid ORDER BY ts, rank)) AS BIGINT) AS depth FROM run)"""


def _ops(spark, d):
    return events(spark, d).where(F.col("type").isin("view", "click", "purchase", "error")), F.col("type").isin("view", "click")


@query("state_push_pop_depth", f"WITH {_OPS} SELECT tid, rank, depth FROM dep")
def state_push_pop_depth(spark, d):
    ops, push = _ops(spark, d)
    return st.depths(ops, ["tid"], push, ("ts", "rank")).select("tid", "rank", "depth")


@query("state_stack_intervals", f"""WITH {_OPS}, b AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY tid ORDER BY ts, rank) AS before FROM dep),
p AS (SELECT * FROM b WHERE s = 1)
SELECT p.tid, p.depth, p.ts AS start, p.type AS value, coalesce((SELECT min(q.ts) FROM b q WHERE q.tid = p.tid AND q.s = -1 AND q.before > q.depth AND q.depth = p.depth - 1 AND (q.ts, q.rank) > (p.ts, p.rank)) - 1, {END}) AS "end" FROM p""")
def state_stack_intervals(spark, d):
    ops, push = _ops(spark, d)
    return st.stack_intervals(ops, ["tid"], push, "type", END, ("ts", "rank"))


@query("state_stack_top", f"""WITH {_OPS}, l AS (SELECT tid, max_by(depth, (ts, rank)) AS depth FROM (SELECT * FROM dep WHERE ts <= {T0 + 10 * DAY}) GROUP BY tid)
SELECT tid, depth FROM l WHERE depth > 0""")
def state_stack_top(spark, d):
    ops, push = _ops(spark, d)
    return st.stack_top(st.stack_intervals(ops, ["tid"], push, "type", END, ("ts", "rank")), ["tid"], T0 + 10 * DAY).select("tid", "depth")


@query("state_queue", f"""WITH {_OPS}, b AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY tid ORDER BY ts, rank) AS before FROM dep),
n AS (SELECT *, row_number() OVER (PARTITION BY tid, s ORDER BY ts, rank) AS n FROM b WHERE s = 1 OR before > depth)
SELECT a.tid, a.n, a.ts AS offered, a.cents, z.ts AS polled FROM n a LEFT JOIN n z ON a.tid = z.tid AND a.n = z.n AND z.s = -1 WHERE a.s = 1""")
def state_queue(spark, d):
    ops, push = _ops(spark, d)
    return st.queue_items(ops, ["tid"], push, "cents", ("ts", "rank")).select("tid", F.col("n").cast("long").alias("n"), "offered", "cents", "polled")


@query("state_pool_slots")
def state_pool_slots(spark, d):
    items = segments(spark, d).select("name", F.col("rank").alias("id"), "start", "end")
    return st.pool_slots(items, ["name"])


@query("state_update_ongoing", f"""WITH {IV}, u AS (SELECT tid, ts, rank, 'u' || CAST(k AS VARCHAR) AS nv FROM ev WHERE type = 'error' AND k > 60),
h AS (SELECT iv.tid, iv.start, max_by(u.nv, (u.ts, u.rank)) AS nv FROM iv JOIN u ON u.tid = iv.tid AND u.ts BETWEEN iv.start AND iv."end" GROUP BY ALL)
SELECT iv.tid, iv.start, iv."end", coalesce(h.nv, iv.value) AS value FROM iv LEFT JOIN h ON h.tid = iv.tid AND h.start = iv.start""")
def state_update_ongoing(spark, d):
    updates = events(spark, d).where("type = 'error' and k > 60").select("tid", "ts", F.col("rank").alias("seq"), F.concat(F.lit("u"), F.col("k").cast("string")).alias("value"))
    return st.update_ongoing(type_intervals(spark, d), updates, ["tid"], 6 * HOUR).select("tid", "start", "end", "value")


_PATHS = "paths AS (SELECT DISTINCT ['Users', CAST(user_id % 4 AS VARCHAR), CAST(user_id AS VARCHAR), event_type] AS path FROM events)"


def _paths(spark, d):
    e = events(spark, d)
    return e.select(F.array(F.lit("Users"), F.col("cpu").cast("string"), F.col("tid").cast("string"), F.col("type")).alias("path")).distinct()


@query("state_wildcard_paths", f"WITH {_PATHS} SELECT array_to_string(path, '/') AS path FROM paths WHERE path[2] = '3' AND path[4] = 'error'")
def state_wildcard_paths(spark, d):
    return st.wildcard(_paths(spark, d), ["Users", "x", "..", "3", "*", "error"]).select(F.array_join("path", "/").alias("path"))


@query("state_sub_attributes", f"WITH {_PATHS} SELECT array_to_string(path, '/') AS path FROM paths WHERE path[2] = '1' AND regexp_matches(path[4], '^(view|sign)')")
def state_sub_attributes(spark, d):
    return st.below(_paths(spark, d), ["Users", "1"], regex="^(view|sign)").select(F.array_join("path", "/").alias("path"))


@query("state_remove_attribute", f"WITH {_PATHS} SELECT array_to_string(path, '/') AS path, {T0 + DAY} AS ts FROM paths WHERE path[2] = '2'")
def state_remove_attribute(spark, d):
    gone = spark.createDataFrame([(["Users", "2"], T0 + DAY, 0)], "path array<string>, ts long, seq long")
    return st.removals(_paths(spark, d), gone).select(F.array_join("path", "/").alias("path"), "ts")


@query("state_range_min_max", f'WITH {NIV} SELECT tid, min(value) AS minimum, max(value) AS maximum FROM iv WHERE start <= {T0 + 9 * DAY} AND "end" >= {T0 + 2 * DAY} GROUP BY tid')
def state_range_min_max(spark, d):
    return st.range_extremes(cents_intervals(spark, d), ["tid"], T0 + 2 * DAY, T0 + 9 * DAY)


@query("state_time_weighted_avg", f"""WITH {NIV} SELECT tid, round(CAST(coalesce(sum(value * (least({T0 + 9 * DAY}, "end" + 1) - greatest({T0 + 2 * DAY}, start))), 0) AS DOUBLE) / {7 * DAY}, 4) AS average
FROM iv WHERE start <= {T0 + 9 * DAY} AND "end" >= {T0 + 2 * DAY} GROUP BY tid""")
def state_time_weighted_avg(spark, d):
    return st.time_weighted_average(cents_intervals(spark, d), ["tid"], T0 + 2 * DAY, T0 + 9 * DAY).select("tid", F.round("average", 4).alias("average"))


@query("mipmap_rollup", f"""WITH {NIV}, l0 AS (SELECT 0 AS level, tid, start // {HOUR} AS bucket, min(value) AS minimum, max(value) AS maximum, CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM iv GROUP BY ALL),
l1 AS (SELECT 1 AS level, tid, bucket // 16 AS bucket, min(minimum) AS minimum, max(maximum) AS maximum, CAST(sum(total) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n FROM l0 GROUP BY ALL),
l2 AS (SELECT 2 AS level, tid, bucket // 16 AS bucket, min(minimum) AS minimum, max(maximum) AS maximum, CAST(sum(total) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n FROM l1 GROUP BY ALL)
SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def mipmap_rollup(spark, d):
    return st.mipmap(cents_intervals(spark, d), ["tid"], HOUR)


@query("state_snapshot_restore", f'WITH {IV} SELECT tid, start, "end", value FROM iv WHERE start <= {T0 + 8 * DAY} AND "end" >= {T0 + 8 * DAY}')
def state_snapshot_restore(spark, d):
    rows = type_intervals(spark, d)
    return st.restored(st.snapshot(rows, T0 + 8 * DAY), rows.schema)


# ---------------------------------------------------------------- counters


def _counter(spark, d):
    return ag.counter(events(spark, d), ["cpu"], F.col("cents"), cumulative=False).select("cpu", "ts", "rank", F.col("value").cast("double").alias("value"))


_XY = f"""{EV}, c AS (SELECT cpu, ts, rank, CAST(sum(cents) OVER (PARTITION BY cpu ORDER BY ts, rank) AS DOUBLE) AS value FROM ev),
g AS (SELECT unnest([{", ".join(str(T0 + k * DAY) for k in range(1, 30, 4))}]) AS t), cp AS (SELECT DISTINCT cpu FROM ev),
xy AS (SELECT cp.cpu, g.t, coalesce((SELECT max_by(c.value, (c.ts, c.rank)) FROM c WHERE c.cpu = cp.cpu AND c.ts <= g.t), 0.0) AS value FROM cp CROSS JOIN g)"""
_XY_TIMES = [T0 + k * DAY for k in range(1, 30, 4)]


@query("counter_cumulative_xy", f"WITH {_XY} SELECT cpu, t, value FROM xy")
def counter_cumulative_xy(spark, d):
    return ag.sampled_counter(_counter(spark, d), ["cpu"], _XY_TIMES)


@query("counter_differential_xy", f"WITH {_XY} SELECT cpu, t, value - coalesce(lag(value) OVER (PARTITION BY cpu ORDER BY t), 0.0) AS value FROM xy")
def counter_differential_xy(spark, d):
    return ag.sampled_counter(_counter(spark, d), ["cpu"], _XY_TIMES, differential=True)


@query("counter_groups", f"WITH {EV} SELECT cpu, type, rank, CAST(sum(k) OVER (PARTITION BY cpu, type ORDER BY ts, rank) AS BIGINT) AS value FROM ev")
def counter_groups(spark, d):
    return ag.counter(events(spark, d), ["cpu", "type"], F.col("k"), cumulative=False).select("cpu", "type", "rank", "value")


# ---------------------------------------------------------------- segments


@query("pair_latency_segments", f'WITH {SEG} SELECT tid, start, "end", "end" - start AS duration FROM seg')
def pair_latency_segments(spark, d):
    return segments(spark, d).select("tid", "start", "end", se.length().alias("duration"))


def _rounded(df, total="long"):
    return df.withColumn("mean", F.round("mean", 1)).withColumn("deviation", F.round("deviation", 0)).withColumn("total", F.col("total").cast(total))


_STATS = 'count(*) AS n, min("end" - start) AS minimum, max("end" - start) AS maximum, round(avg("end" - start), 1) AS mean, CASE WHEN count(*) > 2 THEN round(stddev_samp("end" - start), 0) END AS deviation, CAST(sum("end" - start) AS BIGINT) AS total'


@query("segment_stats_rollup", f"WITH {SEG} SELECT name, {_STATS} FROM seg GROUP BY ROLLUP (name)")
def segment_stats_rollup(spark, d):
    return _rounded(se.statistics(segments(spark, d), ["name"], se.length(), total=True))


@query("segment_stats_selection", f"""WITH {SEG}, sel AS (SELECT * FROM seg WHERE start <= {T0 + 14 * DAY} AND "end" >= {T0 + 6 * DAY})
SELECT 'Total' AS root, coalesce(name, 'Total') AS label, {_STATS} FROM seg GROUP BY ROLLUP (name) UNION ALL SELECT 'Selection', coalesce(name, 'Selection'), {_STATS} FROM sel GROUP BY ROLLUP (name)""")
def segment_stats_selection(spark, d):
    return _rounded(se.with_selection(segments(spark, d), "name", T0 + 6 * DAY, T0 + 14 * DAY))


@query("segment_extremes", f"""WITH {SEG} SELECT name, min_by(start, ("end" - start, start, "end")) AS min_start, min_by("end", ("end" - start, start, "end")) AS min_end, max_by(start, ("end" - start, -start, -"end")) AS max_start, max_by("end", ("end" - start, -start, -"end")) AS max_end FROM seg GROUP BY name""")
def segment_extremes(spark, d):
    return se.extremes(segments(spark, d), ["name"], se.length())


@query("segment_density", f"""WITH {SEG}, w AS (SELECT max("end" - start) // 40 AS w FROM seg) SELECT name, CAST(least(("end" - start) // w, 39) AS INTEGER) AS bin, count(*) AS n FROM seg CROSS JOIN w WHERE w > 0 GROUP BY ALL""")
def segment_density(spark, d):
    return se.density(segments(spark, d), "name", 40)


@query("segment_scatter_compact")
def segment_scatter_compact(spark, d):
    return se.scatter(segments(spark, d), "name", T0, END, 60)


@query("segment_table_page", f'WITH {SEG} SELECT tid, start, "end" FROM seg ORDER BY "end" - start DESC, start, "end", tid LIMIT 30 OFFSET 20')
def segment_table_page(spark, d):
    return se.page(segments(spark, d), [se.length().desc()], 20, 30, ["start", "end", "tid"]).select("tid", "start", "end")


@query("segment_stab", f'WITH {SEG} SELECT tid, start, "end" FROM seg WHERE start <= {T0 + 10 * DAY} AND "end" >= {T0 + 10 * DAY}')
def segment_stab(spark, d):
    return se.stab(segments(spark, d), T0 + 10 * DAY).select("tid", "start", "end")


@query("segment_overlap_join", f"""WITH {SEG}, s AS (SELECT * FROM seg) SELECT a.rank AS a, b.rank AS b, greatest(a.start, b.start) AS o_start, least(a."end", b."end") AS o_end FROM s a JOIN s b ON a.start <= b."end" AND a."end" >= b.start AND a.name = b.name AND a.rank < b.rank""")
def segment_overlap_join(spark, d):
    s = segments(spark, d)
    return ma.clipped(s, s, HOUR, ["name"]).where("rank < b_rank").select(F.col("rank").alias("a"), F.col("b_rank").alias("b"), "o_start", "o_end")


@query("segment_distinct", f'WITH {SEG} SELECT DISTINCT start // {HOUR} AS start, "end" // {HOUR} AS "end" FROM seg')
def segment_distinct(spark, d):
    return segments(spark, d).select(F.floor(F.col("start") / HOUR).alias("start"), F.floor(F.col("end") / HOUR).alias("end")).dropDuplicates()


@query("order_segments_stats", """WITH o AS (SELECT o_orderkey, o_orderpriority AS name, epoch_us(o_orderdate) AS start FROM orders), l AS (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS "end" FROM lineitem GROUP BY l_orderkey),
seg AS (SELECT name, start, "end" FROM o JOIN l ON l_orderkey = o_orderkey WHERE "end" >= start) SELECT name, """ + _STATS.replace("AS BIGINT) AS total", "AS DECIMAL(30, 0)) AS total") + " FROM seg GROUP BY ROLLUP (name)")  # beyond a long at sf0.1
def order_segments_stats(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), micros("o_orderdate").alias("start"))
    ends = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(micros("l_shipdate")).alias("end"))
    return _rounded(se.statistics(o.join(ends, "o_orderkey").where(F.col("end") >= F.col("start")), ["name"], se.length(), total=True), "decimal(30,0)")


# ---------------------------------------------------------------- joins and matching


@query("asof_state_at_event", f"""WITH {EV}, v AS (SELECT * FROM ev WHERE type = 'view'), p AS (SELECT * FROM ev WHERE type = 'purchase')
SELECT p.rank, p.tid, (SELECT max_by(v.cents, (v.ts, v.rank)) FROM v WHERE v.tid = p.tid AND v.ts <= p.ts) AS last_cents FROM p""")
def asof_state_at_event(spark, d):
    e = events(spark, d)
    views = e.where("type = 'view'").select("tid", F.col("ts").alias("v_ts"), F.col("rank").alias("v_rank"), F.col("cents").alias("last_cents"))
    return as_of(e.where("type = 'purchase'").select("rank", "tid", "ts"), views, ["tid"], "ts", "v_ts", ["last_cents"], tie="v_rank").select("rank", "tid", "last_cents")


@query("state_at_event", f"""WITH {IV}, e AS (SELECT rank, tid, ts FROM ev WHERE type = 'error') SELECT e.rank, iv.value, iv.start FROM e JOIN iv ON iv.tid = e.tid AND e.ts - 1 BETWEEN iv.start AND iv."end\"""")
def state_at_event(spark, d):
    e = events(spark, d).where("type = 'error'").select("rank", "tid", (F.col("ts") - 1).alias("at"))
    return point_join(e, type_intervals(spark, d), "at", 6 * HOUR, ["tid"]).select("rank", F.col("i_value").alias("value"), F.col("i_start").alias("start"))


_PAIRS = f"""{EV}, c AS (SELECT *, row_number() OVER (PARTITION BY k, type ORDER BY ts, rank) AS n FROM ev WHERE type IN ('signup', 'purchase')),
pr AS (SELECT a.k, a.n, a.ts AS src_ts, b.ts AS dst_ts FROM c a JOIN c b ON a.k = b.k AND a.n = b.n AND a.type = 'signup' AND b.type = 'purchase')"""


@query("event_match_cause_effect", f"WITH {_PAIRS} SELECT k, src_ts, dst_ts, src_ts > dst_ts AS reverse, abs(dst_ts - src_ts) AS duration FROM pr")
def event_match_cause_effect(spark, d):
    return ma.latencies(ma.match(events(spark, d), ["k"], F.col("type") == "signup", F.col("type") == "purchase")).select("k", "src_ts", "dst_ts", "reverse", "duration")


@query("event_match_hosts")
def event_match_hosts(spark, d):
    e = events(spark, d).where(F.col("type").isin("signup", "purchase")).select("k", F.col("cpu").cast("string").alias("host"), "ts", "rank", F.when(F.col("type") == "signup", "CAUSE").otherwise("EFFECT").alias("direction"))
    return ma.match_hosts(e, ["k"])


@query("unmatched_events", f"WITH {EV} SELECT rank, tid FROM ev a WHERE type = 'signup' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.type = 'error' AND b.tid = a.tid AND b.k = a.k)")
def unmatched_events(spark, d):
    return ma.unmatched(events(spark, d), ["tid", "k"], F.col("type") == "signup", F.col("type") == "error").select("rank", "tid")


@query("potential_leaks", f"""WITH {EV}, r AS (SELECT tid * 100 + k AS ptr, ts, tid, cents AS size, type = 'click' AS alloc FROM ev WHERE type IN ('click', 'error')), n AS (SELECT *, lead(alloc) OVER (PARTITION BY ptr ORDER BY ts, alloc) AS nx FROM r)
SELECT ptr, tid, size, ts AS start, ts AS "end" FROM n WHERE alloc AND coalesce(nx, true)""")
def potential_leaks(spark, d):
    e = events(spark, d).withColumn("ptr", F.col("tid") * 100 + F.col("k"))
    return ma.leaks(e.where("type = 'click'").select("ptr", "ts", "tid", F.col("cents").alias("size")), e.where("type = 'error'").select("ptr", "ts"))


@query("memory_ledger", f"""WITH {EV}, l AS (SELECT tid, rank, CAST(sum(CASE type WHEN 'click' THEN cents WHEN 'error' THEN -cents ELSE 0 END) OVER w AS BIGINT) AS total, ts FROM ev WINDOW w AS (PARTITION BY tid ORDER BY ts, rank))
SELECT tid, rank, total, min(total) OVER (PARTITION BY tid ORDER BY ts, rank) AS lowest FROM l""")
def memory_ledger(spark, d):
    amount = F.when(F.col("type") == "click", F.col("cents")).when(F.col("type") == "error", -F.col("cents")).otherwise(F.lit(0).cast("long"))
    return ma.ledger(events(spark, d), ["tid"], amount).select("tid", "rank", "total", "lowest")


@query("heap_memory", f"""WITH {EV}, a AS (SELECT *, tid * 100 + k % 10 AS ptr, CASE type WHEN 'error' THEN 'free' ELSE 'malloc' END AS op FROM ev WHERE type IN ('click', 'error')),
s AS (SELECT *, lag(cents) OVER w AS ps, lag(op) OVER w AS po FROM a WINDOW w AS (PARTITION BY ptr ORDER BY ts, rank)),
m AS (SELECT *, coalesce(CASE WHEN op = 'free' THEN CASE WHEN po <> 'free' THEN -ps ELSE 0 END ELSE cents END, 0) AS amount FROM s)
SELECT tid, rank, CAST(sum(amount) OVER (PARTITION BY tid ORDER BY ts, rank) AS BIGINT) AS total FROM m""")
def heap_memory(spark, d):
    e = events(spark, d).where(F.col("type").isin("click", "error"))
    e = e.select("tid", "ts", "rank", (F.col("tid") * 100 + F.col("k") % 10).alias("ptr"), F.when(F.col("type") == "error", "free").otherwise("malloc").alias("type"), F.col("cents").alias("size"))
    return ke.heap_memory(e).select("tid", "rank", "total")


@query("symbol_resolution", f"""WITH {EV}, s AS (SELECT p_partkey * 37 AS base, CASE WHEN p_size % 2 = 0 THEN p_size END AS size, p_name AS name FROM part), c AS (SELECT rank, cents AS address FROM ev WHERE type = 'view')
SELECT rank, CASE WHEN size IS NULL OR address < base + size THEN name END AS symbol FROM (SELECT c.*, s.* FROM c ASOF LEFT JOIN s ON c.address >= s.base)""")
def symbol_resolution(spark, d):
    symbols = table(spark, d, "part").select(F.lit(0).alias("pid"), (F.col("p_partkey") * 37).alias("base"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"), F.col("p_name").alias("name"))
    calls = events(spark, d).where("type = 'view'").select("rank", F.lit(0).alias("pid"), F.col("cents").alias("address"))
    return ma.resolve_symbols(calls, symbols).select("rank", "symbol")


# ---------------------------------------------------------------- operating system


@query("cpu_usage_in_range", f"""WITH {SW}, r AS (SELECT cpu, tid, least("end", {T0 + 9 * DAY}) - greatest(start, {T0 + 3 * DAY}) AS t FROM run WHERE tid <> 0 AND start < {T0 + 9 * DAY} AND "end" > {T0 + 3 * DAY})
SELECT cpu, tid, CAST(sum(t) AS BIGINT) AS time, round(100.0 * CAST(sum(t) AS DOUBLE) / {6 * DAY}, 6) AS percent FROM r GROUP BY CUBE (cpu, tid)""")
def cpu_usage_in_range(spark, d):
    return ke.cpu_usage(run_intervals(spark, d), T0 + 3 * DAY, T0 + 9 * DAY).select("cpu", "tid", "time", F.round("percent", 6).alias("percent"))


@query("cpu_usage_xy", f"""WITH {SW}, g AS (SELECT unnest(range(0, 29)) AS i), s AS (SELECT {T0} + i * {DAY} AS a, {T0} + (i + 1) * {DAY} AS b FROM g),
x AS (SELECT run.tid, s.b AS t, least(run."end", s.b) - greatest(run.start, s.a) AS q FROM run JOIN s ON run.start < s.b AND run."end" > s.a WHERE tid <> 0)
SELECT 'total' AS series, t, round(100.0 * CAST(sum(q) AS DOUBLE) / {DAY}, 6) AS percent FROM x GROUP BY t UNION ALL SELECT CAST(tid AS VARCHAR), t, round(100.0 * CAST(sum(q) AS DOUBLE) / {DAY}, 6) FROM x WHERE tid IN (3, 17) GROUP BY tid, t""")
def cpu_usage_xy(spark, d):
    return ke.cpu_usage_xy(run_intervals(spark, d), [T0 + k * DAY for k in range(30)], [3, 17]).select("series", "t", F.round("percent", 6).alias("percent"))


@query("context_switch_count", f"WITH {EV} SELECT cpu, count(*) AS n FROM ev WHERE ts BETWEEN {T0 + DAY} AND {T0 + 5 * DAY} GROUP BY ROLLUP (cpu)")
def context_switch_count(spark, d):
    return ke.context_switches(switches(spark, d), T0 + DAY, T0 + 5 * DAY)


@query("thread_on_cpu", f'WITH {SW} SELECT cpu, tid FROM run WHERE start <= {T0 + 10 * DAY} AND "end" > {T0 + 10 * DAY}')
def thread_on_cpu(spark, d):
    return run_intervals(spark, d).where((F.col("start") <= T0 + 10 * DAY) & (F.col("end") > T0 + 10 * DAY)).select("cpu", "tid")


def _kernel(spark, d):
    """Users' events as tracepoints: views switch their CPU, clicks enter a call that purchases leave, errors wake."""
    e = events(spark, d)
    t = F.col("type")
    kind = F.when(t == "view", "sched_switch").when(t == "click", "syscall_entry_open").when(t == "purchase", "syscall_exit_open").when(t == "error", "sched_wakeup").otherwise("cpu_frequency")
    e = global_lag(e, "ts", ["ts", "rank"], None, ["tid"], keys=["cpu"])
    prev = F.coalesce("prev_tid", F.lit(0))
    return e.select("ts", "rank", "cpu", kind.alias("type"), "tid", prev.alias("prev_tid"), F.col("tid").alias("next_tid"), (F.col("k") % 4).alias("prev_state"), F.concat(F.lit("t"), F.col("tid").cast("string")).alias("next_comm"), F.col("k").alias("next_prio"), F.col("cents").alias("frequency"), F.lit(None).cast("long").alias("irq"), F.lit(None).cast("long").alias("child_tid"), F.lit(None).cast("long").alias("parent_tid"), F.col("k").alias("ret"))


def _change(path: str, k: int, value: str, where: str) -> str:
    return f"SELECT {path} AS path, ts, rank * 16 + {k} AS q, {value} AS v FROM p WHERE {where}"


_THREAD = "'Threads/' || CASE WHEN {0} = 0 THEN '0_' || CAST(cpu AS VARCHAR) ELSE CAST({0} AS VARCHAR) END || '/{1}'"
_KERNEL_CHANGES = " UNION ALL ".join([
    _change(_THREAD.format("prev", "Status"), 0, "CASE WHEN k % 4 = 0 THEN 'WAIT_CPU' ELSE 'WAIT_BLOCKED' END", "type = 'view'"),
    _change(_THREAD.format("tid", "Status"), 1, "'RUN_USERMODE'", "type = 'view'"),
    _change(_THREAD.format("tid", "Exec_name"), 2, "'t' || CAST(tid AS VARCHAR)", "type = 'view'"),
    _change(_THREAD.format("tid", "Prio"), 3, "CAST(k AS VARCHAR)", "type = 'view'"),
    _change(_THREAD.format("tid", "Current_cpu_rq"), 4, "CAST(cpu AS VARCHAR)", "type = 'view'"),
    _change("'CPUs/' || CAST(cpu AS VARCHAR) || '/Current_thread'", 5, "CAST(tid AS VARCHAR)", "type = 'view'"),
    _change("'CPUs/' || CAST(cpu AS VARCHAR) || '/Status'", 6, "CASE WHEN tid = 0 THEN 'IDLE' ELSE 'RUN_USERMODE' END", "type = 'view'"),
    _change(_THREAD.format("tid", "Status"), 0, "CASE type WHEN 'click' THEN 'RUN_SYSTEMCALL' WHEN 'purchase' THEN 'RUN_USERMODE' ELSE 'WAIT_CPU' END", "type IN ('click', 'purchase', 'error')"),
    _change(_THREAD.format("tid", "System_call"), 1, "CASE type WHEN 'click' THEN 'open' END", "type IN ('click', 'purchase')"),
    _change("'CPUs/' || CAST(cpu AS VARCHAR) || '/Status'", 2, "CASE type WHEN 'click' THEN 'RUN_SYSTEMCALL' ELSE 'RUN_USERMODE' END", "type IN ('click', 'purchase')"),
    _change("'CPUs/' || CAST(cpu AS VARCHAR) || '/Frequency'", 0, "CAST(cents AS VARCHAR)", "type = 'signup'"),
])


@query("kernel_state_intervals", f"""WITH {EV}, p AS (SELECT *, coalesce(lag(tid) OVER (PARTITION BY cpu ORDER BY ts, rank), 0) AS prev FROM ev), c AS ({_KERNEL_CHANGES}),
lw AS (SELECT path, ts, v FROM c QUALIFY row_number() OVER (PARTITION BY path, ts ORDER BY q DESC) = 1), st AS (SELECT * FROM lw UNION ALL SELECT path, {T0}, NULL FROM lw GROUP BY path HAVING min(ts) > {T0}),
ch AS (SELECT *, lag(v) OVER (PARTITION BY path ORDER BY ts) AS pv, row_number() OVER (PARTITION BY path ORDER BY ts) AS n FROM st)
SELECT path, ts AS start, coalesce(lead(ts) OVER (PARTITION BY path ORDER BY ts) - 1, {END}) AS "end", v AS value FROM ch WHERE n = 1 OR v IS DISTINCT FROM pv""")
def kernel_state_intervals(spark, d):
    changes = ke.state_changes(_kernel(spark, d)).withColumn("path", F.array_join("path", "/"))
    return st.intervals(changes, ["path"], END, start=T0)


@query("kernel_thread_status_at", f"""WITH {EV}, p AS (SELECT *, coalesce(lag(tid) OVER (PARTITION BY cpu ORDER BY ts, rank), 0) AS prev FROM ev),
c AS (SELECT prev AS t, ts, rank * 10 AS q, CASE WHEN k % 4 = 0 THEN 'WAIT_CPU' ELSE 'WAIT_BLOCKED' END AS s FROM p WHERE type = 'view' AND prev <> 0 UNION ALL SELECT tid, ts, rank * 10 + 1, 'RUN_USERMODE' FROM p WHERE type = 'view'
UNION ALL SELECT tid, ts, rank * 10, CASE type WHEN 'click' THEN 'RUN_SYSTEMCALL' WHEN 'purchase' THEN 'RUN_USERMODE' ELSE 'WAIT_CPU' END FROM p WHERE type IN ('click', 'purchase', 'error'))
SELECT CAST(t AS VARCHAR) AS tid, max_by(s, (ts, q)) AS value FROM c WHERE t <> 0 AND ts <= {T0 + 12 * DAY} GROUP BY t""")
def kernel_thread_status_at(spark, d):
    changes = ke.state_changes(_kernel(spark, d)).where((F.col("path")[0] == "Threads") & (F.col("path")[2] == "Status") & ~F.col("path")[1].startswith("0_"))
    # Of a switch of a thread to itself the incoming status counts; both come from one event, so the status orders them.
    ordered = changes.withColumn("seq", F.col("seq") * 10 + F.when(F.col("value") == "RUN_USERMODE", 1).otherwise(0))
    return st.at_time(st.intervals(ordered, ["path"], END), T0 + 12 * DAY).select(F.col("path")[1].alias("tid"), "value")


@query("syscall_latency_stats", f"""WITH {EV}, be AS (SELECT *, lag(type) OVER w AS p, lag(ts) OVER w AS start FROM ev WHERE type IN ('click', 'purchase') WINDOW w AS (PARTITION BY tid ORDER BY ts, rank)), seg AS (SELECT 'open' AS name, start, ts AS "end" FROM be WHERE type = 'purchase' AND p = 'click')
SELECT name, {_STATS} FROM seg GROUP BY name""")
def syscall_latency_stats(spark, d):
    return _rounded(se.statistics(ke.syscalls(_kernel(spark, d)), ["name"], se.length()))


@query("wakeup_latency", f"""WITH {EV}, be AS (SELECT *, lag(type) OVER w AS p, lag(ts) OVER w AS start FROM ev WHERE type IN ('error', 'view') WINDOW w AS (PARTITION BY tid ORDER BY ts, rank)) SELECT tid AS target, start, ts AS "end", k AS prio FROM be WHERE type = 'view' AND p = 'error'""")
def wakeup_latency(spark, d):
    return ke.wakeup_latency(_kernel(spark, d).select("ts", "rank", "type", F.col("tid").alias("target"), F.col("next_prio").alias("prio")))


_DISK = f"""{EV}, be AS (SELECT *, lag(type) OVER w AS p, lag(ts) OVER w AS issued, lag(k) OVER w AS sectors FROM ev WHERE type IN ('click', 'error') WINDOW w AS (PARTITION BY cpu, tid ORDER BY ts, rank)), rq AS (SELECT cpu AS dev, issued, ts AS completed, sectors FROM be WHERE type = 'error' AND p = 'click')"""


@query("disk_sectors_at", f"WITH {_DISK} SELECT dev, round(sum(sectors * CASE WHEN completed <= {T0 + 15 * DAY} THEN 1.0 ELSE CAST({T0 + 15 * DAY} - issued AS DOUBLE) / (completed - issued) END), 4) AS sectors FROM rq WHERE issued <= {T0 + 15 * DAY} GROUP BY dev")
def disk_sectors_at(spark, d):
    e = events(spark, d).select("ts", "rank", F.col("cpu").alias("dev"), F.col("tid").alias("sector"), F.when(F.col("type") == "click", "block_rq_issue").when(F.col("type") == "error", "block_rq_complete").alias("type"), F.col("k").alias("nr_sector"), F.lit("R").alias("rw"))
    return ke.sectors_at(ke.disk_requests(e), T0 + 15 * DAY).select("dev", F.round("sectors", 4).alias("sectors"))


@query("packet_streams", f"""WITH {EV}, p AS (SELECT type AS protocol, 'h' || CAST(tid % 7 AS VARCHAR) AS src, 'h' || CAST(k % 5 AS VARCHAR) AS dst, cents AS bytes, ts FROM ev)
SELECT protocol, least(src, dst) AS a, greatest(src, dst) AS b, count(*) FILTER (src = least(src, dst)) AS packets_ab, count(*) FILTER (src <> least(src, dst)) AS packets_ba, CAST(coalesce(sum(bytes) FILTER (src = least(src, dst)), 0) AS BIGINT) AS bytes_ab, CAST(coalesce(sum(bytes) FILTER (src <> least(src, dst)), 0) AS BIGINT) AS bytes_ba, min(ts) AS start, max(ts) AS stop FROM p GROUP BY protocol, least(src, dst), greatest(src, dst)""")
def packet_streams(spark, d):
    p = events(spark, d).select(F.col("type").alias("protocol"), F.concat(F.lit("h"), (F.col("tid") % 7).cast("string")).alias("src"), F.concat(F.lit("h"), (F.col("k") % 5).cast("string")).alias("dst"), F.col("cents").alias("bytes"), "ts")
    return ag.streams(p).drop("bps")


# ---------------------------------------------------------------- trees, call graphs, graphs


_TREE = "leaf AS (SELECT [r_name, n_name, c_mktsegment] AS path, CAST(round(o_totalprice * 100) AS BIGINT) AS w, o_orderpriority AS g FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def _leaves(spark, d):
    r, n, c, o = (table(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    # region and nation are dimension tables of fixed size; orders meet customers by a shuffle or what AQE finds small.
    places = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(places, F.col("o_custkey") == F.col("c_custkey")).select(F.array("r_name", "n_name", "c_mktsegment").alias("path"), F.round(F.col("o_totalprice") * 100).cast("long").alias("w"), F.array("o_orderpriority", "o_orderstatus").alias("g"))


@query("weighted_tree", f"WITH {_TREE}, e AS (SELECT list_slice(path, 1, i) AS p, w FROM leaf, range(1, 4) t(i)) SELECT array_to_string(p, '/') AS path, CAST(sum(w) AS BIGINT) AS weight, count(*) AS n FROM e GROUP BY p")
def weighted_tree(spark, d):
    # Equal leaves fold before each is spread over its prefixes.
    leaves = _leaves(spark, d).groupBy("path").agg(F.sum("w").alias("w"), F.count("*").alias("m"))
    tree = leaves.withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k)))).groupBy("p").agg(F.sum("w").alias("weight"), F.sum("m").alias("n"))
    return tree.select(F.array_join("p", "/").alias("path"), "weight", "n")


@query("tree_regroup", f"WITH {_TREE} SELECT g, array_to_string(path, '/') AS path, CAST(sum(w) AS BIGINT) AS weight, count(*) AS n FROM leaf GROUP BY g, path")
def tree_regroup(spark, d):
    leaves = _leaves(spark, d).groupBy("g", "path").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))
    return ag.regroup(leaves, "g", 1).select(F.col("g")[0].alias("g"), F.array_join("path", "/").alias("path"), "weight", "n")


def _calls(spark, d):
    e = events(spark, d).where(F.col("type").isin("view", "click", "purchase", "error"))
    e = e.select("tid", "ts", "rank", F.concat(F.col("type"), (F.col("k") % 3).cast("string")).alias("name"), F.col("type").isin("view", "click").alias("entry"))
    return cs.calls(e, ["tid"], END)


@query("call_stack")
def call_stack(spark, d):
    return _calls(spark, d)


@query("call_depth_histogram", f"WITH {_OPS} SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n FROM dep WHERE s = 1 GROUP BY depth")
def call_depth_histogram(spark, d):
    return _calls(spark, d).groupBy("depth").agg(F.count("*").alias("n"))


# Calls as rows: of each push the pop that ends it, the latest push of each lesser depth as its ancestors, and what its children took.
_CALLS = f"""{EV}, ops AS (SELECT tid, ts, rank, type || CAST(k % 3 AS VARCHAR) AS name, CASE WHEN type IN ('view', 'click') THEN 1 ELSE -1 END AS s FROM ev WHERE type IN ('view', 'click', 'purchase', 'error')),
cum AS (SELECT *, sum(s) OVER (PARTITION BY tid ORDER BY ts, rank) AS c FROM ops), dep AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY tid ORDER BY ts, rank)) AS depth FROM cum),
bef AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY tid ORDER BY ts, rank) AS before FROM dep), p AS (SELECT * FROM bef WHERE s = 1),
anc AS (SELECT p.rank AS id, a.depth, arg_max(a.name, (a.ts, a.rank)) AS name, arg_max(a.rank, (a.ts, a.rank)) AS up FROM p JOIN p a ON a.tid = p.tid AND a.depth <= p.depth AND (a.ts, a.rank) <= (p.ts, p.rank) GROUP BY p.rank, a.depth),
paths AS (SELECT id, list(name ORDER BY depth) AS path FROM anc GROUP BY id),
whole AS (SELECT p.rank AS id, p.tid, CAST(p.depth AS INTEGER) AS depth, p.name, path, up AS parent, p.ts AS start, coalesce((SELECT min(q.ts) FROM bef q WHERE q.tid = p.tid AND q.s = -1 AND q.before > q.depth AND q.depth = p.depth - 1 AND (q.ts, q.rank) > (p.ts, p.rank)), {END}) AS "end"
FROM p JOIN paths ON paths.id = p.rank LEFT JOIN anc ON anc.id = p.rank AND anc.depth = p.depth - 1)"""


def _with_self(source: str) -> str:
    return f"""inn AS (SELECT parent, CAST(sum("end" - start) AS BIGINT) AS t FROM {source} WHERE parent IS NOT NULL GROUP BY parent), calls AS (SELECT {source}.*, "end" - start - coalesce(t, 0) AS self_time FROM {source} LEFT JOIN inn ON inn.parent = id)"""


_GRAPH = """graph AS (SELECT path, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS duration, CAST(sum(self_time) AS BIGINT) AS self_time, min("end" - start) AS minimum, max("end" - start) AS maximum, avg("end" - start) AS mean, CASE WHEN count(*) > 2 THEN stddev_samp("end" - start) END AS deviation FROM calls GROUP BY path)"""


@query("call_table", f"""WITH {_CALLS}, {_with_self("whole")} SELECT id, tid, parent, depth, name, array_to_string(path, '/') AS path, start, "end", self_time FROM calls""")
def call_table(spark, d):
    return _calls(spark, d).withColumn("path", F.array_join("path", "/"))


@query("call_statistics", f"""WITH {_CALLS} SELECT name, {_STATS} FROM whole GROUP BY name""")
def call_statistics(spark, d):
    return _rounded(cs.function_statistics(_calls(spark, d)))


@query("calls_at_depth", f"""WITH {_CALLS} SELECT id, tid, start, "end" FROM whole WHERE depth = 2 AND start <= {T0 + 8 * DAY} AND "end" >= {T0 + 6 * DAY}""")
def calls_at_depth(spark, d):
    return cs.at_depth(_calls(spark, d), 2, T0 + 6 * DAY, T0 + 8 * DAY).select("id", "tid", "start", "end")


@query("next_call_in_parent", f"""WITH {_CALLS} SELECT id, tid, lead(id) OVER (PARTITION BY tid, parent ORDER BY start, id) AS next FROM whole""")
def next_call_in_parent(spark, d):
    return cs.next_in_parent(_calls(spark, d), ["tid"]).select("id", "tid", "next")


@query("call_max_depth", f"""WITH {_CALLS} SELECT tid, max(depth) AS depth FROM whole GROUP BY tid""")
def call_max_depth(spark, d):
    return cs.max_depth(_calls(spark, d), ["tid"])


@query("call_graph_self_time", f"""WITH {_CALLS}, {_with_self("whole")}, {_GRAPH} SELECT array_to_string(path, '/') AS path, n, duration, self_time, minimum, maximum, round(mean, 1) AS mean, round(deviation, 0) AS deviation FROM graph""")
def call_graph_self_time(spark, d):
    g = cs.call_graph(cs.self_times(_calls(spark, d), ["tid"]))
    return g.select(F.array_join("path", "/").alias("path"), "n", "duration", "self_time", "minimum", "maximum", F.round("mean", 1).alias("mean"), F.round("deviation", 0).alias("deviation"))


@query("call_graph_in_range", f"""WITH {_CALLS}, cut AS (SELECT * REPLACE (greatest(start, {T0 + 5 * DAY}) AS start, least("end", {T0 + 8 * DAY}) AS "end") FROM whole WHERE start <= {T0 + 8 * DAY} AND "end" >= {T0 + 5 * DAY}), {_with_self("cut")}, {_GRAPH}
SELECT array_to_string(path, '/') AS path, n, duration, self_time FROM graph""")
def call_graph_in_range(spark, d):
    g = cs.call_graph_in_range(_calls(spark, d), ["tid"], T0 + 5 * DAY, T0 + 8 * DAY)
    return g.select(F.array_join("path", "/").alias("path"), "n", "duration", "self_time")


@query("flame_graph", f"""WITH {_CALLS}, {_with_self("whole")}, {_GRAPH}, box AS (SELECT path, list_slice(path, 1, len(path) - 1) AS up, duration AS width FROM graph),
off AS (SELECT path, width, coalesce(sum(width) OVER (PARTITION BY up ORDER BY width DESC, path[-1] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM box)
SELECT array_to_string(a.path, '/') AS path, CAST(len(a.path) AS INTEGER) AS depth, CAST(sum(b.o) AS BIGINT) AS x, a.width FROM off a JOIN off b ON list_slice(a.path, 1, len(b.path)) = b.path GROUP BY a.path, a.width""")
def flame_graph(spark, d):
    return cs.flame(cs.call_graph(_calls(spark, d))).select(F.array_join("path", "/").alias("path"), "depth", "x", "width")


@query("sampled_call_graph", f"""WITH {EV}, s AS (SELECT CASE WHEN k % 2 = 0 THEN ['main', type, 'f' || CAST(k % 5 AS VARCHAR)] ELSE ['main', type] END AS stack FROM ev), p AS (SELECT list_slice(stack, 1, i) AS p FROM s, range(1, 4) t(i) WHERE i <= len(stack)) SELECT array_to_string(p, '/') AS path, count(*) AS weight FROM p GROUP BY p""")
def sampled_call_graph(spark, d):
    e = events(spark, d)
    stack = F.when(F.col("k") % 2 == 0, F.array(F.lit("main"), F.col("type"), F.concat(F.lit("f"), (F.col("k") % 5).cast("string")))).otherwise(F.array(F.lit("main"), F.col("type")))
    return cs.sampled_graph(e.select(stack.alias("stack"))).select(F.array_join("path", "/").alias("path"), "weight")


def _edges(spark, d):
    e = events(spark, d)
    sw = switches(spark, d).join(e.where("type = 'view'").select("rank", (F.col("k") % 3).alias("prev_state")), "rank")
    wake = e.where("type = 'click'").select("ts", "rank", F.col("tid").alias("waker"), ((F.col("tid") + F.col("k")) % 150).alias("target"))
    return gr.execution_graph(sw, wake)


_EDGES = f"""{EV}, sw AS (SELECT *, coalesce(lag(tid) OVER (PARTITION BY cpu ORDER BY ts, rank), 0) AS prev FROM ev), wk AS (SELECT ts, rank, tid AS waker, (tid + k) % 150 AS target FROM ev WHERE type = 'click'),
pt AS (SELECT prev AS w, ts, rank, CASE WHEN k % 3 = 0 THEN 'PREEMPTED' ELSE 'BLOCKED' END AS s, 0 AS o FROM sw WHERE type = 'view' UNION ALL SELECT tid, ts, rank, 'RUNNING', 0 FROM sw WHERE type = 'view' UNION ALL SELECT target, ts, rank, 'PREEMPTED', 0 FROM wk UNION ALL SELECT waker, ts, rank, 'RUNNING', 0 FROM wk),
hz AS (SELECT w, ts, lead(ts) OVER (PARTITION BY w ORDER BY ts, rank) AS nx FROM pt WHERE w <> 0)"""


@query("graph_worker_times", f"""WITH {_EDGES}, t AS (SELECT w AS worker, CAST(sum(nx - ts) AS BIGINT) AS time FROM hz WHERE nx IS NOT NULL GROUP BY w) SELECT worker, time, round(100.0 * time / (SELECT CAST(sum(time) AS DOUBLE) FROM t), 6) AS percent FROM t""")
def graph_worker_times(spark, d):
    return gr.worker_times(_edges(spark, d)).select("worker", "time", F.round("percent", 6).alias("percent"))


@query("graph_worker_ends", f"WITH {_EDGES}, v AS (SELECT w, ts FROM hz WHERE nx IS NOT NULL UNION ALL SELECT w, nx FROM hz WHERE nx IS NOT NULL UNION ALL SELECT waker, ts FROM wk WHERE waker <> 0 AND target <> waker UNION ALL SELECT target, ts FROM wk WHERE waker <> 0 AND target <> waker) SELECT w AS worker, min(ts) AS head, max(ts) AS tail, count(DISTINCT ts) AS n FROM v GROUP BY w")
def graph_worker_ends(spark, d):
    return gr.ends(_edges(spark, d).where("src_worker <> dst_worker or src_ts <> dst_ts or state <> 'DEFAULT'"))


@query("critical_path")
def critical_path(spark, d):
    return gr.critical_path(_edges(spark, d), 5)


# ---------------------------------------------------------------- clocks, scalars, definitions


@query("clock_correction", f"WITH {EV} SELECT rank, CASE WHEN cpu = 1 THEN ts + 250 WHEN cpu = 2 THEN ts - 1000 ELSE ts END AS ts FROM ev")
def clock_correction(spark, d):
    f = ck.Fraction
    return ck.corrected(events(spark, d).withColumn("host", F.col("cpu").cast("string")), {"1": ck.Linear(beta=f(250)), "2": ck.Linear(beta=f(1000)).inverse()}).select("rank", "ts")


@query("clock_synchronisation")
def clock_synchronisation(spark, d):
    e = events(spark, d).where("type in ('click', 'view')")
    a = F.col("cpu") % 2 == 0
    sent = e.select(F.when(a, "a").otherwise("b").alias("src_host"), F.when(a, F.col("ts")).otherwise(F.col("ts") + 5000).alias("src_ts"), F.when(a, "b").otherwise("a").alias("dst_host"), F.when(a, F.col("ts") + 5000 + F.col("k") * 10).otherwise(F.col("ts") + F.col("k") * 10).alias("dst_ts"))
    return ck.synchronise(sent)


@query("periodic_markers", f"SELECT {T0} + i * {DAY} AS start, {T0} + (i + 1) * {DAY} AS \"end\", i % 7 AS index FROM range(3, 21) t(i)")
def periodic_markers(spark, d):
    return ck.periodic_markers(spark, T0, DAY, 7, T0 + 3 * DAY, T0 + 20 * DAY)


@query("scalar_numbers", f"""WITH {EV} SELECT rank, CASE k % 3 WHEN 0 THEN k WHEN 1 THEN k ELSE -k END AS decoded, printf('0x%x', k) AS hex, CASE WHEN tid % 2 = 0 THEN 9223372036854775807 ELSE -9223372036854775808 END AS clamped,
printf('%d.%d.%d.%d', (cents * 7919 >> 24) & 255, (cents * 7919 >> 16) & 255, (cents * 7919 >> 8) & 255, cents * 7919 & 255) AS ip, printf('%.2f %%', k / 100.0 * 100) AS share FROM ev""")
def scalar_numbers(spark, d):
    e = events(spark, d)
    text = F.when(F.col("k") % 3 == 0, sc.radix("k", 16)).when(F.col("k") % 3 == 1, F.col("k").cast("string")).otherwise(F.concat(F.lit("-"), F.col("k").cast("string")))
    top = F.when(F.col("tid") % 2 == 0, sc.saturated_add(F.lit(sc.LONG_MAX - 5), F.col("rank") + 10)).otherwise(sc.saturated_subtract(F.lit(sc.LONG_MIN + 5), F.col("rank") + 10))
    return e.select("rank", sc.decode_number(text).alias("decoded"), sc.radix("k", 16).alias("hex"), top.alias("clamped"), sc.ipv4(F.col("cents") * 7919).alias("ip"), sc.percent(F.col("k") / 100.0).alias("share"))


@query("scalar_units")
def scalar_units(spark, d):
    e = events(spark, d)
    return e.select("rank", sc.with_prefix("cents").alias("si"), sc.data_size("cents").alias("size"), sc.duration("cents").alias("duration"), sc.format_ns(F.col("ts") * 1000).alias("time"))


_DEFINITION = """<stateProvider><location id="U"><stateAttribute type="constant" value="Users"/><stateAttribute type="eventField" value="tid"/></location>
<mappingGroup id="g"><entry value="LOOKS"><stateValue type="string" value="view"/></entry></mappingGroup>
<eventHandler eventName="vi*"><stateChange><stateAttribute type="location" value="U"/><stateAttribute type="constant" value="does"/><stateValue type="eventName" mappingGroup="g"/></stateChange></eventHandler>
<eventHandler eventName="purchase"><stateChange><if><condition operator="gt"><stateValue type="eventField" value="k"/><stateValue type="long" value="50"/></condition></if>
<then><stateAttribute type="location" value="U"/><stateAttribute type="constant" value="does"/><stateValue type="string" value="BUYS MUCH"/></then>
<else><stateAttribute type="location" value="U"/><stateAttribute type="constant" value="does"/><stateValue type="string" value="BUYS"/></else></stateChange></eventHandler></stateProvider>"""


@query("declarative_states", f"""WITH {EV}, c AS (SELECT tid, ts, rank, CASE WHEN type = 'view' THEN 'LOOKS' WHEN k > 50 THEN 'BUYS MUCH' ELSE 'BUYS' END AS value FROM ev WHERE type IN ('view', 'purchase')),
x AS (SELECT *, lag(value) OVER (PARTITION BY tid ORDER BY ts, rank) AS p FROM c), y AS (SELECT * FROM x WHERE p IS NULL OR p <> value)
SELECT 'Users/' || CAST(tid AS VARCHAR) || '/does' AS path, ts AS start, coalesce(lead(ts) OVER (PARTITION BY tid ORDER BY ts, rank) - 1, {END}) AS "end", value FROM y""")
def declarative_states(spark, d):
    changes = de.from_xml(_DEFINITION).changes(events(spark, d))
    return st.intervals(changes, ["path"], END).withColumn("path", F.array_join("path", "/"))


@query("pattern_scenarios")
def pattern_scenarios(spark, d):
    m = de.Machine("none", "bought", [de.Transition("none", "seen", ["view"], store=["k"]), de.Transition("seen", "picked", ["click"]), de.Transition("picked", "bought", ["purchase"])])
    return de.scenarios(events(spark, d), m, ["tid"], ["k"]).select("tid", "status", "state", "start", "end")


@query("running_and_previous", f"""WITH {EV}, x AS (SELECT rank, ts, cents, lag(cents) OVER (ORDER BY ts, rank) AS prev_cents FROM ev) SELECT rank, prev_cents, cents - prev_cents AS step FROM x""")
def running_and_previous(spark, d):
    rows = global_lag(events(spark, d).select("rank", "ts", "cents"), "ts", ["ts", "rank"], None, ["cents"])
    return rows.select("rank", "prev_cents", (F.col("cents") - F.col("prev_cents")).alias("step"))


@query("top_latencies", f'WITH {SEG} SELECT tid, start, "end" - start AS duration FROM seg ORDER BY duration DESC, start, tid LIMIT 10')
def top_latencies(spark, d):
    return segments(spark, d).select("tid", "start", se.length().alias("duration")).orderBy(F.desc("duration"), "start", "tid").limit(10)


@query("session_windows", f"""WITH {EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tid ORDER BY ts, rank) >= {6 * HOUR} THEN 1 ELSE 0 END AS b FROM ev), s AS (SELECT *, sum(b) OVER (PARTITION BY tid ORDER BY ts, rank) AS i FROM g)
SELECT tid, min(ts) AS start, max(ts) + {6 * HOUR} AS "end", count(*) AS n FROM s GROUP BY tid, i""")
def session_windows(spark, d):
    rows = events(spark, d).select("tid", F.timestamp_micros("ts").alias("t"))
    out = rows.groupBy("tid", F.session_window("t", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("tid", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n")


@query("stream_windows", f"WITH {EV} SELECT ts // {DAY} * {DAY} AS start, type, count(*) AS n FROM ev GROUP BY ALL")
def stream_windows(spark, d):
    """The streaming form over what is available, with its windows as rows."""
    import uuid

    from .streaming import queries as sq

    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = rows.select(F.timestamp_micros(micros("ts")).alias("t"), "event_type", "value")
    out = sq.drain(sq.counts(rows, "t", "1 hour", "1 day"), "complete", f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}")
    return out.select(F.unix_micros("window.start").alias("start"), F.col("event_type").alias("type"), "n")


from . import view_queries as _view_queries  # noqa: E402, F401  (adds its queries to those above)
