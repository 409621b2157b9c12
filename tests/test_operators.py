"""Operators that no SQL oracle covers, on small literal inputs."""

import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as sc
from tickloom.operators import clocks as ck, declarative as de, filters as fi, graphs as gr, kernel as ke, matching as ma, segments as se, states as st
from tickloom.plans import as_of, overlap_join, point_join
from tickloom.sources import readers as rd


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "alpha", 5.0, None), (2, "beta", 20.0, "x"), (3, None, None, "y z")], "rank long, name string, n double, note string")

    def ranks(text):
        return sorted(r.rank for r in fi.filter_events(df, text).collect())

    assert ranks("name == alpha") == [1]
    assert ranks("name != alpha") == [2, 3]  # a missing field is not equal
    assert ranks("n > 10") == [2] and ranks("!(n > 10)") == [1, 3]
    assert ranks("note present") == [2, 3]
    assert ranks("name contains et || note matches '^y'") == [2, 3]
    assert ranks("name == alpha || name == beta && n > 10") == [2]  # no precedence
    assert ranks('"y z"') == [3] and ranks("beta") == [2]
    for bad in ("name ==", "(name == a", "n > word", "&& x"):
        with pytest.raises(ValueError):
            fi.filter_events(df, bad)


def test_filter_nodes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "rank long, name string")
    resolve = fi.resolver(df)
    pick = lambda node: sorted(r.rank for r in df.where(node.column(resolve)).collect())
    assert pick(fi.And()) == [] and pick(fi.Or()) == [] and pick(fi.And(negated=True)) == [1, 2]
    assert pick(fi.Equals("name", "a", negated=True)) == [2]
    assert pick(fi.Compare("name", 0, "5", negated=True)) == []
    assert pick(fi.Matches("name", "A|a")) == [1]


def test_conditions(spark):
    df = spark.createDataFrame([(0, 4), (5, 9)], "start long, end long")
    assert df.where(fi.discrete([4, 20])(F.col("start"), F.col("end"))).count() == 1
    assert df.where(fi.continuous(4, 5)(F.col("start"), F.col("end"))).count() == 2


def test_push_pop(spark):
    ops = spark.createDataFrame([("s", t, t, p, v) for t, p, v in [(1, False, None), (2, True, "a"), (4, True, "b"), (6, False, None), (7, False, None), (8, False, None), (9, True, "c")]], "k string, ts long, seq long, push boolean, v string")
    got = sorted((r.depth, r.start, r.end, r.value) for r in st.stack_intervals(ops, ["k"], F.col("push"), "v", 20).collect())
    assert got == [(1, 2, 6, "a"), (1, 9, 20, "c"), (2, 4, 5, "b")]


def test_interval_rules(spark):
    changes = spark.createDataFrame([("q", 5, 1, 1), ("q", 5, 2, 2), ("q", 7, 3, 2), ("q", 9, 4, None), ("q", 12, 5, 3)], "k string, ts long, seq long, value int")
    got = [(r.start, r.end, r.value) for r in st.intervals(changes, ["k"], 20, start=0).orderBy("start").collect()]
    assert got == [(0, 4, None), (5, 8, 2), (9, 11, None), (12, 20, 3)]
    assert st.time_grid(0, 10, 4) == [0, 4, 8, 10] and st.time_grid(0, 2, 0) == [0, 1, 2]
    with pytest.raises(ValueError, match="outside"):
        st.check_time(30, 0, 20)


def test_interval_joins_equal_nested_loops(spark):
    import random

    rng = random.Random(2)
    a, b = ([(i, s, s + rng.randrange(60)) for i, s in enumerate(rng.randrange(-200, 200) for _ in range(80))] for _ in range(2))
    x, y = (spark.createDataFrame(t, "id long, start long, end long") for t in (a, b))
    for width in (1, 7, 1000):
        got = sorted((r.id, r.b_id) for r in overlap_join(x, y, width).collect())
        assert got == sorted((i, j) for i, s, e in a for j, t, f in b if s <= f and e >= t)
        got = sorted((r.id, r.i_id) for r in point_join(x, y, "start", width).collect())
        assert got == sorted((i, j) for i, s, _ in a for j, t, f in b if t <= s <= f)


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, s long, v string")
    assert sorted((r.k, r.t, r.v) for r in as_of(left, right, ["k"], "t", "s", ["v"]).collect()) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]
    assert sorted((r.t, r.v) for r in as_of(left, right, ["k"], "t", "s", ["v"], strict=True).where("k = 'a'").collect()) == [(1, None), (5, "x")]


def test_pairing_last_begin_wins(spark):
    e = spark.createDataFrame([(1, 0, "b"), (2, 1, "b"), (4, 2, "e"), (5, 3, "e"), (6, 4, "b")], "ts long, rank long, type string").withColumn("k", F.lit(1))
    got = [(r.start, r.end) for r in se.pair(e, ["k"], F.col("type") == "b", F.col("type") == "e").collect()]
    assert got == [(2, 4)]


def test_statistics_small_groups(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 0, 8), ("b", 0, 1), ("b", 0, 2), ("b", 0, 3)], "name string, start long, end long")
    got = {r.name: r.deviation for r in se.statistics(df, ["name"], se.length()).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_match_hosts(spark):
    rows = [("h1", 1, 1, "CAUSE"), ("h1", 2, 2, "CAUSE"), ("h2", 3, 3, "EFFECT"), ("h2", 4, 4, "EFFECT"), ("h2", 5, 5, "CAUSE"), ("h1", 6, 6, "EFFECT")]
    e = spark.createDataFrame([(1, *r) for r in rows], "key long, host string, ts long, rank long, direction string")
    got = sorted((r.src_ts, r.dst_ts) for r in ma.match_hosts(e, ["key"]).collect())
    assert got == [(1, 3), (5, 6)]


def test_clock_hull():
    true = ck.Linear(Fraction(1001, 1000), Fraction(500))
    pairs = []
    for k in range(0, 100_000, 1000):
        pairs.append((true(k) - 30 - k % 7000 // 100, k, True))  # sent by a before it arrives at b
        pairs.append((true(k) + 25 + k % 3000 // 50, k, False))
    found, quality = ck.hull(pairs)
    assert quality == ck.ACCURATE and abs(found(50_000) - true(50_000)) <= 30
    assert ck.hull([])[1] == ck.ABSENT and ck.hull([(1, 2, True)])[1] == ck.INCOMPLETE
    assert found.after(found.inverse()) == ck.Linear()
    tree = ck.spanning_tree([("a", "b", found, ck.ACCURATE), ("b", "c", ck.Linear(beta=Fraction(7)), ck.APPROXIMATE)], "a")
    assert tree["c"](10) == found(17)


def test_clock_columns(spark):
    df = spark.createDataFrame([(1_700_000_000_000_000_000,), (5,)], "ts long")
    t = ck.Linear(Fraction(1_000_001, 1_000_000), Fraction(3))
    assert [r[0] for r in df.select(t.column(F.col("ts"))).collect()] == [t(1_700_000_000_000_000_000), t(5)]


def test_critical_path(spark):
    rows = [(1, 0, 1, 4, "RUNNING"), (1, 4, 1, 10, "BLOCKED"), (1, 10, 1, 12, "RUNNING"), (2, 0, 2, 6, "RUNNING"), (2, 6, 2, 10, "RUNNING"), (2, 10, 1, 10, "DEFAULT"), (3, 0, 3, 9, "RUNNING")]
    edges = spark.createDataFrame(rows, "src_worker long, src_ts long, dst_worker long, dst_ts long, state string")
    got = [(r.src_worker, r.src_ts, r.dst_worker, r.dst_ts) for r in gr.critical_path(edges, 1).orderBy("step").collect()]
    assert got == [(1, 0, 1, 4), (2, 4, 2, 6), (2, 6, 2, 10), (2, 10, 1, 10), (1, 10, 1, 12)]
    assert sorted(r.worker for r in gr.reachable(edges, [1]).collect()) == [1, 2]


def test_kernel_runs_and_status(spark):
    sw = spark.createDataFrame([(5, 0, 0, 1, 2), (8, 1, 0, 2, 0)], "ts long, rank long, cpu int, prev_tid long, next_tid long")
    assert sorted((r.tid, r.start, r.end) for r in ke.runs(sw, 0, 10).collect()) == [(0, 8, 10), (1, 0, 5), (2, 5, 8)]
    df = spark.createDataFrame([(0,), (1,), (2,), (64,), (4,), (1024,)], "s long")
    assert [r[0] for r in df.select(ke.status_of(F.col("s"))).collect()] == ["WAIT_CPU", "WAIT_BLOCKED", "WAIT_BLOCKED", "NOT_ALIVE", "WAIT_UNKNOWN", "WAIT_CPU"]


def test_machine():
    m = de.Machine("i", "f", [de.Transition("i", "a", ["x"], store=["k"]), de.Transition("a", "f", ["y"], same=["k"])])
    events = [{"type": "x", "ts": 1, "k": 1}, {"type": "x", "ts": 2, "k": 2}, {"type": "y", "ts": 3, "k": 2}, {"type": "y", "ts": 4, "k": 9}]
    got = sorted((s["status"], s["start"], s["end"]) for s in m.run(events))
    assert got == [("IN_PROGRESS", 1, 1), ("MATCHED", 2, 3)]


def test_scalars(spark):
    df = spark.createDataFrame([(1500, "0x1f"), (0, "017"), (2048, "-12"), (7, "zz")], "n long, t string")
    rows = df.select(sc.with_prefix("n"), sc.data_size("n"), sc.decode_number("t"), sc.duration(F.col("n") * 1000), sc.format_ns(F.lit(1_000_000_001))).collect()
    assert [r[0] for r in rows] == ["1.5 k", "0", "2.048 k", "7"]
    assert [r[1] for r in rows] == ["1.465 KB", "0 B", "2 KB", "7 B"]
    assert [r[2] for r in rows] == [31, 15, -12, None]
    assert rows[0][3] == "1.5 ms" and rows[0][4] == "1970-01-01 00:00:01.000 000 001"
    assert sc.parse_number("0x10") == 16 and sc.parse_number("2 ms") == 2_000_000 and sc.parse_number("a") is None
    top = spark.range(1).select(sc.saturated_add(F.lit(sc.LONG_MAX), F.lit(1)), sc.saturated_multiply(F.lit(sc.LONG_MIN), F.lit(2))).first()
    assert tuple(top) == (sc.LONG_MAX, sc.LONG_MIN)


def _frame(payload=b"hi"):
    udp = struct.pack(">HHHH", 53, 99, 8 + len(payload), 0) + payload
    ip = bytes([0x45, 0]) + struct.pack(">H", 20 + len(udp)) + bytes([0, 0, 0, 0, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + udp
    return bytes(range(12)) + b"\x08\x00" + ip


def test_packets(spark, tmp_path):
    frame = _frame()
    old = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 3, 5, len(frame), len(frame)) + frame + b"cut"
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    pad = frame + b"\0" * (-len(frame) % 4)
    new = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + b"\1\0\0\0" + b"\xff" * 8) + block(1, struct.pack("<HHI", 1, 0, 0)) + block(6, struct.pack("<IIIII", 0, 0, 3_000_005, len(frame), len(frame)) + pad)
    (tmp_path / "a.pcap").write_bytes(old)
    (tmp_path / "b.pcapng").write_bytes(new)
    rows = rd.packets(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and {r.ts for r in rows} == {3_000_005_000}
    for r in rows:
        assert r.protocols == ["ETHERNET_II", "IPV4", "UDP"] and (r.src, r.src_port, r.dst, r.dst_port) == ("10.0.0.1", 53, "10.0.0.2", 99) and bytes(r.payload) == b"hi"
    assert rd.dissect(b"short")["protocols"] == ["UNKNOWN"]
    assert rd.detect(old)[0] == ("pcap", 100) and rd.detect(b"{}")[0][0] == "json"


def test_text_and_btf(spark, tmp_path):
    (tmp_path / "log.txt").write_text("noise\n10 A: one\n  more\n12 B: two\n")
    rows = rd.text_events(spark, str(tmp_path / "log.txt"), r"^(\d+) (\w): (.*)", ["t", "type", "message"]).orderBy("rank").collect()
    assert [(r.t, r.type, r.text) for r in rows] == [("10", "A", "10 A: one\n  more"), ("12", "B", "12 B: two")]
    (tmp_path / "x.btf").write_text("#version 2.0\n#timeScale us\n5, Core, 0, T, Task, 1, activate\n9,Core,0,T,Task,1,terminate,note\n")
    b = rd.btf_events(spark, str(tmp_path / "x.btf"), rd.btf_scale(spark, str(tmp_path / "x.btf")))
    assert [(r.ts, r.event) for r in b.orderBy("ts").collect()] == [(5000, "activate"), (9000, "terminate")]
    got = [r.value for r in ke.btf_changes(b).orderBy("ts").collect()]
    assert got == ["ACTIVE", None]


def test_reports_json_xml(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"results": [{"class": "T", "data": [["a", {"class": "duration", "value": 5}], ["b", 7]]}]}')
    rows = rd.report_rows(spark, str(tmp_path / "r.json")).orderBy("row").collect()
    assert [(r["class"], r.row, len(r.cells)) for r in rows] == [("T", 0, 2), ("T", 1, 2)]
    (tmp_path / "e.json").write_text('{"t": 5, "n": "b"}\n{"t": 2, "n": "a"}\n')
    assert [r.n for r in rd.json_events(spark, str(tmp_path / "e.json"), "t long, n string", "t").orderBy("ts").collect()] == ["a", "b"]
    (tmp_path / "e.xml").write_text("<r><e><t>1</t></e><e><t>2</t></e></r>")
    assert rd.xml_events(spark, str(tmp_path / "e.xml"), "e").count() == 2


def test_history_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 5, 1), ("b", 3, 9, 2)], "k string, start long, end long, value int")
    rd.write_history(rows, str(tmp_path / "h"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "h")).collect())) == sorted(map(tuple, rows.collect()))


def test_stream_pairs(spark, tmp_path):
    from tickloom.streaming import queries as sq

    rows = [(1, 10, 0, "view"), (1, 20, 1, "purchase"), (2, 30, 2, "purchase"), (2, 40, 3, "view")]
    spark.createDataFrame(rows, "tid long, micros long, rank long, type string").write.parquet(str(tmp_path / "in"))
    stream = sq.read(spark, str(tmp_path / "in"), "tid long, micros long, rank long, type string")
    query = sq.pairs(stream, "tid", "view", "purchase").writeStream.format("memory").queryName("stream_pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("stream_pairs").collect()] == [(1, 10, 20)]


def _wake_chain(n, end):
    """Each worker but the last is blocked from 0 on until the next one, having run for 2, wakes it."""
    edges = [(n, 0, n, end - 2 * n + 2, "RUNNING")]
    for i in range(n):
        edges += [(i, 0, i, end - 2 * i, "BLOCKED"), (i + 1, end - 2 * i, i, end - 2 * i, "DEFAULT")]
        edges += [(i, end - 2 * i, i, end - 2 * i + 2, "RUNNING")]
    return edges


_EDGE = "src_worker long, src_ts long, dst_worker long, dst_ts long, state string"


def test_critical_path_follows_a_long_chain_of_wakeups(spark):
    n, end = 24, 1000
    edges = spark.createDataFrame(_wake_chain(n, end), _EDGE)
    assert gr.reachable(edges, [0]).count() == n + 1
    rows = gr.critical_path(edges, 0).collect()
    assert sorted((r.src_ts, r.dst_ts) for r in rows if r.state == "RUNNING") == [(0, end - 2 * n + 2)] + [(end - 2 * i, end - 2 * i + 2) for i in range(n - 1, -1, -1)]
    assert {r.state for r in rows} == {"RUNNING", "DEFAULT"}


def test_critical_path_resolves_deeply_nested_blocks(spark):
    n, end = 1500, 4000
    hub = [(9999, 2 * end + i, i, 2 * end + i, "DEFAULT") for i in range(n + 1)]  # few rounds find all workers
    rows = gr.critical_path(spark.createDataFrame(_wake_chain(n, end) + hub, _EDGE), 0).orderBy("step").collect()
    assert {r.state for r in rows} == {"RUNNING", "DEFAULT"} and sum(r.state == "RUNNING" for r in rows) == n + 1
    assert (rows[0].src_worker, rows[0].src_ts) == (n, 0) and all(a.dst_ts <= b.src_ts for a, b in zip(rows, rows[1:]))


def test_critical_path_ends_where_workers_wake_each_other_at_one_time(spark):
    edges = [(1, 0, 1, 10, "BLOCKED"), (2, 0, 2, 10, "BLOCKED"), (2, 10, 1, 10, "DEFAULT"), (1, 10, 2, 10, "DEFAULT"), (1, 10, 1, 10, "DEFAULT")]
    rows = gr.critical_path(spark.createDataFrame(edges, _EDGE), 1).collect()
    assert any((r.src_ts, r.dst_ts) == (0, 10) for r in rows)


def test_totals_beyond_a_long(spark):
    rows = spark.range(4).selectExpr("cast(id % 2 as string) as name", "cast(0 as long) as start", "9000000000000000000 as end")
    got = {r.name: r for r in se.statistics(rows, ["name"], se.length(), total=True).collect()}
    assert int(got[None].total) == 4 * 9 * 10**18 and int(got["0"].total) == 2 * 9 * 10**18 and got["1"].maximum == 9 * 10**18


def test_slabs_follow_the_counts(spark, monkeypatch):
    """Ranks, sums and rows before, with most rows in a small part of the time."""
    from pyspark.sql import Window

    from tickloom.plans import global_lag, global_rank, slabs

    monkeypatch.setattr(slabs, "SLAB_ROWS", 40)
    rows = spark.range(1000).selectExpr("id as rank", "case when id < 900 then 500 + id % 7 else id * 1000 end as ts", "id * 3 % 11 as v")
    w = Window.orderBy("ts", "rank")
    assert slabs._slabbed(rows, "ts", None).select("__slab").distinct().count() > 3
    want = {r.rank: (r.n - 1, r.p) for r in rows.select("rank", F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("p")).collect()}
    ranked = {r.rank: r["index"] for r in global_rank(rows, "ts", ["ts", "rank"], None).collect()}
    lagged = {r.rank: r.prev_v for r in global_lag(rows, "ts", ["ts", "rank"], None, ["v"]).collect()}
    assert {k: (ranked[k], lagged[k]) for k in ranked} == want and len(lagged) == 1000
