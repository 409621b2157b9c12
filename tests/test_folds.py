"""Queries that SQL doesn't express, against plain folds over all their rows."""

from tickloom import queries as q

DATA = "/root/testdata/sf0.001"


def _events(spark):
    return [r.asDict() for r in q.events(spark, DATA).orderBy("ts", "rank").collect()]


def test_hosts_match_as_events_pass(spark):
    want, waiting = [], {}
    for e in _events(spark):
        if e["type"] not in ("signup", "purchase"):
            continue
        host, cause = str(e["cpu"]), e["type"] == "signup"
        mine, other = (waiting.setdefault((e["k"], x), []) for x in (cause, not cause))
        at = next((i for i, (h, _) in enumerate(other) if not cause or h != host), None)
        if at is None:
            if host not in [h for h, _ in mine]:
                mine.append((host, e["ts"]))
            continue
        h, t = other.pop(at)
        want.append((e["k"], host, e["ts"], h, t) if cause else (e["k"], h, t, host, e["ts"]))
    got = [tuple(r) for r in q.queries()["event_match_hosts"](spark, DATA).select("k", "src_host", "src_ts", "dst_host", "dst_ts").collect()]
    assert sorted(got) == sorted(want) and want


def test_slots_are_reused_in_the_order_of_release(spark):
    rows = q.queries()["state_pool_slots"](spark, DATA).collect()
    want = {}
    for name in {r.name for r in rows}:
        slots = []  # [end of the last item, when it was released]
        released = 0
        for r in sorted((r for r in rows if r.name == name), key=lambda r: (r.start, r.id)):
            for s in sorted((s for s in slots if s[1] is None and s[0] < r.start), key=lambda s: (s[0], slots.index(s))):
                released += 1
                s[1] = released
            free = [i for i, s in enumerate(slots) if s[1] is not None]
            i = min(free, key=lambda i: slots[i][1]) if free else len(slots)
            if i == len(slots):
                slots.append(None)
            slots[i] = [r.end, None]
            want[name, r.id] = i
    assert {(r.name, r.id): r.slot for r in rows} == want and len(want) == len(rows) > 0


def test_scatter_keeps_what_a_pixel_tells_apart(spark):
    width, want = (q.END - q.T0) // 60, set()
    found = q.segments(spark, DATA).collect()
    for name in {r.name for r in found}:
        last = None
        for s, n in sorted((r.start, r.end - r.start) for r in found if r.name == name):
            if last is None or s // width != last[0] // width or abs(n - last[1]) >= width:
                want.add((name, s, n))
                last = (s, n)
    got = q.queries()["segment_scatter_compact"](spark, DATA).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_scenarios_of_a_pattern(spark):
    """Views open scenarios; a click or a purchase goes to the first one that waits for it."""
    want, waiting = [], {}
    for e in _events(spark):
        own = waiting.setdefault(e["tid"], [])
        if e["type"] == "view":
            own.append([e["tid"], "IN_PROGRESS", "seen", e["ts"], e["ts"]])
        elif e["type"] in ("click", "purchase"):
            before, after = ("seen", "picked") if e["type"] == "click" else ("picked", "bought")
            s = next((s for s in own if s[2] == before), None)
            if s:
                s[2], s[4] = after, e["ts"]
                if after == "bought":
                    s[1] = "MATCHED"
                    own.remove(s)
                    want.append(tuple(s))
    want += [tuple(s) for own in waiting.values() for s in own]
    got = [tuple(r) for r in q.queries()["pattern_scenarios"](spark, DATA).select("tid", "status", "state", "start", "end").collect()]
    assert sorted(got) == sorted(want)
