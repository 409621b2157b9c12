"""Queries of what views show, with their SQL; `queries` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import clocks as ck, filters as fi, kernel as ke, matching as ma, segments as se, states as st, views as vw
from .queries import _DISK, _STATS, DAY, END, EV, HOUR, IV, SEG, T0, _rounded, events, query, segments, table, type_intervals

_TIMES = [T0 + k * DAY for k in range(0, 30, 3)]
_AT = ", ".join(f"({t})" for t in _TIMES)


@query("segment_stats_by_priority", f"""WITH {EV}, be AS (SELECT *, lag(type) OVER w AS p, lag(ts) OVER w AS start FROM ev WHERE type IN ('error', 'view') WINDOW w AS (PARTITION BY tid ORDER BY ts, rank)),
seg AS (SELECT k % 10 AS prio, tid, start, ts AS "end" FROM be WHERE type = 'view' AND p = 'error') SELECT prio, tid, {_STATS} FROM seg GROUP BY ROLLUP (prio, tid)""")
def segment_stats_by_priority(spark, d):
    rows = se.pair(events(spark, d), ["tid"], F.col("type") == "error", F.col("type") == "view").withColumn("prio", F.col("k") % 10)
    return _rounded(se.statistics(rows, ["prio", "tid"], se.length(), total=True))


@query("io_latency_table", f"WITH {_DISK} SELECT dev, issued, completed, sectors, completed - issued AS latency FROM rq WHERE issued <= {T0 + 12 * DAY} AND completed >= {T0 + 10 * DAY}")
def io_latency_table(spark, d):
    rows = _requests(spark, d).where((F.col("issued") <= T0 + 12 * DAY) & (F.col("completed") >= T0 + 10 * DAY))
    return rows.select("dev", "issued", "completed", "sectors", (F.col("completed") - F.col("issued")).alias("latency"))


def _requests(spark, d):
    e = events(spark, d).select("ts", "rank", F.col("cpu").alias("dev"), F.col("tid").alias("sector"), F.when(F.col("type") == "click", "block_rq_issue").when(F.col("type") == "error", "block_rq_complete").alias("type"), F.col("k").alias("nr_sector"), F.lit("R").alias("rw"))
    return ke.disk_requests(e)


@query("disk_io_xy", f"""WITH {_DISK}, g AS (SELECT t AS a, lead(t) OVER (ORDER BY t) AS b FROM (VALUES {_AT}) v(t)),
x AS (SELECT dev, b AS t, sectors * 512 * CAST(least(completed, b) - greatest(issued, a) AS DOUBLE) / (completed - issued) AS bytes, b - a AS span FROM rq JOIN g ON issued < b AND completed > a WHERE b IS NOT NULL)
SELECT dev, t, round(sum(bytes) * 1e6 / any_value(span), 6) AS rate FROM x GROUP BY dev, t""")
def disk_io_xy(spark, d):
    return vw.disk_series(_requests(spark, d), _TIMES).select("dev", "t", F.round("rate", 6).alias("rate"))


_LEDGER = f"""{EV}, l AS (SELECT tid, ts, rank, CAST(sum(CASE type WHEN 'click' THEN cents WHEN 'error' THEN -cents ELSE 0 END) OVER (PARTITION BY tid ORDER BY ts, rank) AS BIGINT) AS value FROM ev)"""


def _ledger(spark, d):
    amount = F.when(F.col("type") == "click", F.col("cents")).when(F.col("type") == "error", -F.col("cents")).otherwise(F.lit(0).cast("long"))
    return ma.ledger(events(spark, d), ["tid"], amount).select("tid", "ts", "rank", F.col("total").alias("value"))


def _memory_sql(value: str) -> str:
    return f"""WITH {_LEDGER}, m AS (SELECT tid, ts, rank, {value} AS value FROM l JOIN (SELECT tid, least(min(value), 0) AS low FROM l GROUP BY tid) USING (tid)),
s AS (SELECT tid, t, max_by(value, (ts, rank)) AS value FROM m JOIN (VALUES {_AT}) g(t) ON ts <= t GROUP BY tid, t)
SELECT CAST(tid AS VARCHAR) AS series, t, value FROM s UNION ALL SELECT 'total', t, CAST(sum(value) AS BIGINT) FROM s GROUP BY t"""


@query("kernel_memory_xy", _memory_sql("value - low"))
def kernel_memory_xy(spark, d):
    return vw.memory_series(_ledger(spark, d), _TIMES, shift=True)


@query("ust_memory_xy", _memory_sql("value"))
def ust_memory_xy(spark, d):
    return vw.memory_series(_ledger(spark, d), _TIMES, shift=False)


_BIN = f"""{EV}, ch AS (SELECT tid, ts, arg_max((cpu + k) % 4, rank) AS value FROM ev GROUP BY tid, ts), x AS (SELECT *, lag(value) OVER (PARTITION BY tid ORDER BY ts) AS p, row_number() OVER (PARTITION BY tid ORDER BY ts) AS n FROM ch)"""


@query("ust_cpu_state", f'WITH {_BIN} SELECT tid, ts AS start, coalesce(lead(ts) OVER (PARTITION BY tid ORDER BY ts) - 1, {END}) AS "end", value FROM x WHERE n = 1 OR value <> p')
def ust_cpu_state(spark, d):
    """The CPU that each thread was last seen on; here a CPU that varies with the event."""
    return st.intervals(events(spark, d).select("tid", "ts", F.col("rank").alias("seq"), ((F.col("cpu") + F.col("k")) % 4).alias("value")), ["tid"], END)


@query("sequence_messages", f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY k, type ORDER BY ts, rank) AS n FROM ev WHERE type IN ('signup', 'purchase'))
SELECT a.cpu AS sender, b.cpu AS receiver, a.ts AS start, b.ts AS "end", a.ts = b.ts AS synchronous FROM n a JOIN n b USING (k, n) WHERE a.type = 'signup' AND b.type = 'purchase'""")
def sequence_messages(spark, d):
    e = events(spark, d)
    pairs = ma.match(e, ["k"], F.col("type") == "signup", F.col("type") == "purchase")
    ends = [e.select("rank", "cpu").withColumnsRenamed({"rank": f"{x}_rank", "cpu": name}) for x, name in (("src", "sender"), ("dst", "receiver"))]
    return vw.messages(pairs.join(ends[0], "src_rank").join(ends[1], "dst_rank"), "sender", "receiver")


@query("calls_in_span", f"""WITH {EV}, ops AS (SELECT *, CASE WHEN type IN ('view', 'click') THEN 1 ELSE -1 END AS s FROM ev WHERE type IN ('view', 'click', 'purchase', 'error')),
c AS (SELECT *, sum(s) OVER w AS c FROM ops WINDOW w AS (PARTITION BY tid ORDER BY ts, rank)), dep AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY tid ORDER BY ts, rank)) AS depth FROM c),
b AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY tid ORDER BY ts, rank) AS before FROM dep), p AS (SELECT * FROM b WHERE s = 1),
iv AS (SELECT p.tid, CAST(p.depth AS INTEGER) AS depth, p.ts AS start, coalesce((SELECT min((q.ts, q.rank)) FROM b q WHERE q.tid = p.tid AND q.s = -1 AND q.before > q.depth AND q.depth = p.depth - 1 AND (q.ts, q.rank) > (p.ts, p.rank))[1], {END}) AS "end", p.rank AS id FROM p)
SELECT id, tid, depth, start, "end" FROM iv WHERE start <= {T0 + 8 * DAY} AND "end" >= {T0 + 7 * DAY}""")
def calls_in_span(spark, d):
    from .queries import _calls

    return st.in_range(_calls(spark, d), T0 + 7 * DAY, T0 + 8 * DAY).select("id", "tid", "depth", "start", "end")


@query("time_range_intersections", f"""WITH {SEG}, s AS (SELECT * FROM seg WHERE name = 'd3') SELECT a.rank AS a, b.rank AS b, greatest(a.start, b.start) AS o_start, least(a."end", b."end") AS o_end, a.start <= b.start AND a."end" >= b."end" AS contains
FROM s a JOIN s b ON a.start <= b."end" AND a."end" >= b.start AND a.rank <> b.rank""")
def time_range_intersections(spark, d):
    s = segments(spark, d).where("name = 'd3'").select("rank", "start", "end")
    return vw.intersection(s, s, DAY).where("rank <> b_rank").select(F.col("rank").alias("a"), F.col("b_rank").alias("b"), "o_start", "o_end", "contains")


@query("time_graph_rows", f"""WITH {IV} SELECT tid, start, "end" - start + 1 AS duration, value AS label FROM iv WHERE start <= {T0 + 9 * DAY} AND "end" >= {T0 + 4 * DAY} AND value <> 'error'""")
def time_graph_rows(spark, d):
    return vw.state_rows(type_intervals(spark, d), ["tid"], T0 + 4 * DAY, T0 + 9 * DAY, F.col("value") != "error")


@query("time_graph_compacted", f"""WITH {IV}, r AS (SELECT tid, start, "end" - start + 1 AS duration, CASE WHEN value IN ('view', 'click') THEN 'looks' ELSE value END AS label FROM iv),
m AS (SELECT *, CASE WHEN label = lag(label) OVER w AND lag(start + duration) OVER w = start THEN 0 ELSE 1 END AS f FROM r WINDOW w AS (PARTITION BY tid ORDER BY start)), g AS (SELECT *, sum(f) OVER (PARTITION BY tid ORDER BY start) AS run FROM m)
SELECT tid, min(start) AS start, CAST(sum(duration) AS BIGINT) AS duration, any_value(label) AS label FROM g GROUP BY tid, run""")
def time_graph_compacted(spark, d):
    rows = vw.state_rows(type_intervals(spark, d), ["tid"], T0, END).withColumn("label", F.when(F.col("label").isin("view", "click"), "looks").otherwise(F.col("label")))
    return vw.compacted(rows, ["tid"])


_RANGES = [0, HOUR, 6 * HOUR, DAY, 5 * DAY, 30 * DAY]


@query("xy_by_range", f"""WITH {SEG}, r AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b})" for a, b in zip(_RANGES, _RANGES[1:]))}) v(low, high)), n AS (SELECT DISTINCT name FROM seg)
SELECT n.name, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, (SELECT count(*) FROM seg s WHERE s.name = n.name AND s."end" - s.start >= low AND s."end" - s.start < high) AS n FROM n CROSS JOIN r""")
def xy_by_range(spark, d):
    return vw.by_category(segments(spark, d), "name", _RANGES, se.length())


@query("xy_delta", f"""WITH {EV}, c AS (SELECT type, ts // {DAY} AS t, count(*) AS n FROM ev GROUP BY ALL) SELECT type, t, n - coalesce(lag(n) OVER (PARTITION BY type ORDER BY t), 0) AS value FROM c""")
def xy_delta(spark, d):
    counts = events(spark, d).groupBy("type", F.floor(F.col("ts") / DAY).alias("t")).agg(F.count("*").alias("value"))
    return vw.deltas(counts, ["type"])


@query("lost_event_annotations", f"WITH {EV} SELECT ts AS start, k * {HOUR} AS duration, cents AS n FROM ev WHERE type = 'error' AND ts <= {T0 + 15 * DAY} AND ts + k * {HOUR} >= {T0 + 10 * DAY}")
def lost_event_annotations(spark, d):
    return vw.lost_events(events(spark, d), F.col("type") == "error", F.col("cents"), F.col("ts") + F.col("k") * HOUR, T0 + 10 * DAY, T0 + 15 * DAY)


_MARKS = f"m AS (SELECT {T0} + i * {DAY} AS start, {T0} + (i + 1) * {DAY} AS \"end\", i % 7 AS index FROM (SELECT unnest(range(0, 30)) AS i))"


@query("split_markers", f"""WITH {_MARKS} SELECT index, CAST(p AS INTEGER) AS part, start + ("end" - start) * p // 7 AS start, start + ("end" - start) * (p + 1) // 7 AS "end" FROM m, range(0, 7) r(p)""")
def split_markers(spark, d):
    return vw.split_markers(ck.periodic_markers(spark, T0, DAY, 7, T0, END), 7)


@query("weighted_markers", f"""WITH {_MARKS} SELECT index, part, start + ("end" - start) * a // 6 AS start, start + ("end" - start) * b // 6 AS "end" FROM m CROSS JOIN (VALUES (0, 0, 1), (1, 1, 3), (2, 3, 6)) w(part, a, b)""")
def weighted_markers(spark, d):
    return vw.weighted_markers(ck.periodic_markers(spark, T0, DAY, 7, T0, END), [1, 2, 3])


@query("chart_numbers", f"WITH {EV} SELECT count(cents) AS n, min(cents) AS minimum, max(cents) AS maximum FROM ev WHERE type <> 'error' AND cents > 100")
def chart_numbers(spark, d):
    return vw.numbers(events(spark, d), F.col("cents"), (F.col("type") != "error") & (F.col("cents") > 100))


@query("event_types", f"WITH {EV}, f AS (SELECT DISTINCT type, unnest(json_keys(props)) AS f FROM ev) SELECT type, n, fields FROM (SELECT type, count(*) AS n FROM ev GROUP BY type) JOIN (SELECT type, string_agg(f, ',' ORDER BY f) AS fields FROM f GROUP BY type) USING (type)")
def event_types(spark, d):
    return vw.event_types(events(spark, d), "props").withColumn("fields", F.array_join("fields", ","))


@query("state_ongoing", f"""WITH {EV}, lw AS (SELECT tid, ts, arg_max(type, rank) AS value FROM ev WHERE ts <= {T0 + 13 * DAY} GROUP BY tid, ts), x AS (SELECT *, lag(value) OVER (PARTITION BY tid ORDER BY ts) AS p FROM lw)
SELECT tid, max(CASE WHEN p IS NULL OR p <> value THEN ts END) AS start, max_by(value, ts) AS value FROM x GROUP BY tid""")
def state_ongoing(spark, d):
    return vw.ongoing(events(spark, d).select("tid", "ts", F.col("rank").alias("seq"), F.col("type").alias("value")), ["tid"], T0 + 13 * DAY)


@query("partial_history", f'WITH {IV} SELECT tid, value FROM iv WHERE start <= {T0 + 17 * DAY + HOUR} AND "end" >= {T0 + 17 * DAY + HOUR}')
def partial_history(spark, d):
    changes = events(spark, d).select("tid", "ts", F.col("rank").alias("seq"), F.col("type").alias("value"))
    return vw.checkpointed_states(changes, type_intervals(spark, d), ["tid"], T0 + 17 * DAY + HOUR, 5 * DAY, T0)


@query("state_backward", f'WITH {IV} SELECT tid, start, "end", value FROM iv ORDER BY "end" DESC, start DESC, tid, value LIMIT 25')
def state_backward(spark, d):
    return vw.backward(type_intervals(spark, d), 25)


@query("varint_codes", f"""WITH {EV}, n AS (SELECT rank, CAST(cents AS UBIGINT) * CAST(cents AS UBIGINT) AS v FROM ev), b AS (SELECT rank, k, v >> (7 * k) AS g FROM n, range(0, 9) r(k))
SELECT rank, string_agg(lower(lpad(hex((g & 127) + CASE WHEN g >> 7 > 0 THEN 128 ELSE 0 END), 2, '0')), '' ORDER BY k) AS code FROM b WHERE k = 0 OR g > 0 GROUP BY rank""")
def varint_codes(spark, d):
    return events(spark, d).select("rank", vw.varint(F.col("cents") * F.col("cents")).alias("code"))


@query("binary_at_address", """WITH l AS (SELECT p_partkey * 40 AS base, p_size AS size, p_name AS path, 1704067200000000 + (p_partkey % 5) * 86400000000 AS loaded, 1704067200000000 + (10 + p_partkey % 7) * 86400000000 AS unloaded FROM part),
c AS (SELECT event_id AS rank, epoch_us(ts) AS ts, CAST(round(value * 100) AS BIGINT) % 8000 AS address FROM events WHERE event_type = 'view') SELECT rank, path, address - base AS "offset" FROM c JOIN l ON address >= base AND address < base + size AND ts >= loaded AND ts < unloaded""")
def binary_at_address(spark, d):
    key = F.col("p_partkey")
    loads = table(spark, d, "part").select(F.lit(1).alias("pid"), (key * 40).alias("base"), F.col("p_size").alias("size"), F.col("p_name").alias("path"), (F.lit(T0) + key % 5 * DAY).alias("loaded"), (F.lit(T0) + (10 + key % 7) * DAY).alias("unloaded"))
    calls = events(spark, d).where("type = 'view'").select("rank", F.lit(1).alias("pid"), "ts", (F.col("cents") % 8000).alias("address"))
    return vw.binaries_at(calls, loads).select("rank", "path", "offset")


@query("filter_matches_regex", f"WITH {EV} SELECT rank FROM ev WHERE regexp_matches(type, '^(view|cl.*)$') AND NOT regexp_matches(props, '7')")
def filter_matches_regex(spark, d):
    tree = fi.And([fi.Matches("type", "^(view|cl.*)$"), fi.Matches("props", "7", negated=True)])
    return events(spark, d).where(tree.column(F.col)).select("rank")


@query("discrete_and_continuous_times", f"""WITH {IV} SELECT tid, start FROM iv WHERE (start <= {T0 + 3 * DAY} AND "end" >= {T0 + 3 * DAY} OR start <= {T0 + 9 * DAY} AND "end" >= {T0 + 9 * DAY}) OR start <= {T0 + 21 * DAY} AND "end" >= {T0 + 20 * DAY}""")
def discrete_and_continuous_times(spark, d):
    points, span = fi.discrete([T0 + 9 * DAY, T0 + 3 * DAY]), fi.continuous(T0 + 20 * DAY, T0 + 21 * DAY)
    rows = type_intervals(spark, d)
    return rows.where(points(F.col("start"), F.col("end")) | span(F.col("start"), F.col("end"))).select("tid", "start")


@query("cycles_and_units", f"WITH {EV} SELECT rank, 1000 + cents * 1000000000 // 2400000 AS ns, cents * 1000 AS micros_in_ns, cents // 1000 AS picos_in_ns FROM ev")
def cycles_and_units(spark, d):
    c = F.col("cents")
    return events(spark, d).select("rank", ck.cycles_to_ns(c, 2_400_000, 1000).alias("ns"), ck.to_nanoseconds(c, -6).alias("micros_in_ns"), ck.to_nanoseconds(c, -12).alias("picos_in_ns"))
