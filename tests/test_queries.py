"""Every query with SQL against that SQL in DuckDB, and the others against a plain fold or an invariant."""

import math
from pathlib import Path

import duckdb
import pytest

from tickloom import queries as q

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(q.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(_plain(dict(zip(names, r))[c]) for c in columns)) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, name):
    assert q.queries()[name](spark, DATA).count() > 0


def test_calls_are_a_walk(spark):
    """Calls against a plain stack."""
    e = q.events(spark, DATA).where("type in ('view', 'click', 'purchase', 'error')").orderBy("tid", "ts", "rank").collect()
    want, stacks = set(), {}
    for r in e:
        s = stacks.setdefault(r.tid, [])
        if r.type in ("view", "click"):
            s.append((r.rank, r.ts))
        elif s:
            i, t = s.pop()
            want.add((r.tid, i, len(s) + 1, t, r.ts))
    for tid, s in stacks.items():
        while s:
            i, t = s.pop()
            want.add((tid, i, len(s) + 1, t, q.END))
    assert {(r.tid, r.id, r.depth, r.start, r.end) for r in q.queries()["call_stack"](spark, DATA).collect()} == want


def test_self_times_add_up(spark):
    g = q.queries()["call_stack"](spark, DATA)
    total = g.where("depth = 1").selectExpr("sum(end - start)").first()[0]
    assert g.selectExpr("sum(self_time)").first()[0] == total


def test_history_has_no_gaps(spark):
    rows = q.queries()["kernel_state_intervals"](spark, DATA).orderBy("path", "start").collect()
    for a, b in zip(rows, rows[1:]):
        if a.path == b.path:
            assert a.end + 1 == b.start and a.value != b.value
        else:
            assert a.end == q.END


def test_pool_slots_do_not_overlap(spark):
    rows = q.queries()["state_pool_slots"](spark, DATA).orderBy("name", "slot", "start").collect()
    for a, b in zip(rows, rows[1:]):
        assert (a.name, a.slot) != (b.name, b.slot) or a.end < b.start


def test_call_graphs_hold_all_calls(spark):
    calls = q.queries()["call_stack"](spark, DATA).collect()
    low, high = q.T0 + 5 * q.DAY, q.T0 + 8 * q.DAY
    within = [c for c in calls if c.start <= high and c.end >= low]
    assert max(c.depth for c in within) > 4 and max(c.depth for c in calls) > 6
    rows = q.queries()["call_graph_self_time"](spark, DATA).collect()
    own = {}
    for c in calls:
        own["/".join(c.path)] = own.get("/".join(c.path), 0) + c.self_time
    assert {r.path: r.self_time for r in rows} == own and sum(r.n for r in rows) == len(calls)
    assert sum(r.n for r in q.queries()["call_graph_in_range"](spark, DATA).collect()) == len(within)
    assert {r.path for r in q.queries()["flame_graph"](spark, DATA).collect()} == set(own)


def test_critical_path_spans_the_trace(spark):
    """The path of a worker ends with its last edge, and its own steps leave no time out."""
    edges = q._edges(spark, DATA).where("src_worker = 5 and dst_worker = 5").collect()
    rows = q.queries()["critical_path"](spark, DATA).orderBy("step").collect()
    assert max(r.dst_ts for r in rows) == max(e.dst_ts for e in edges) > q.T0 + 4 * q.DAY
    assert min(r.src_ts for r in rows) == min(e.src_ts for e in edges)
