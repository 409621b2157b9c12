"""Operating-system analyses over scheduler, interrupt, call, memory and disk events.

Event rows have (ts, rank, cpu, type) and typed fields. Names follow the public tracepoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import global_lag
from .segments import pair

# Thread and CPU status names, and bits of a previous state.
RUN_USER, RUN_SYSCALL, WAIT_CPU, WAIT_BLOCKED, WAIT_UNKNOWN, INTERRUPTED, NOT_ALIVE = "RUN_USERMODE", "RUN_SYSTEMCALL", "WAIT_CPU", "WAIT_BLOCKED", "WAIT_UNKNOWN", "INTERRUPTED", "NOT_ALIVE"
INTERRUPTIBLE, UNINTERRUPTIBLE, DEAD, STATE_MASK = 1, 2, 64, 0x3FF
LAYOUT = {"sched_switch": "sched_switch", "sched_wakeup": "sched_wakeup", "sched_waking": "sched_waking", "sched_process_fork": "sched_process_fork", "sched_process_exit": "sched_process_exit", "irq_entry": "irq_handler_entry", "irq_exit": "irq_handler_exit", "softirq_entry": "softirq_entry", "softirq_exit": "softirq_exit", "softirq_raise": "softirq_raise", "syscall_entry_prefix": "syscall_entry_", "syscall_exit_prefix": "syscall_exit_", "compat_entry_prefix": "compat_syscall_entry_"}
LAYOUTS = {"2.6": LAYOUT, "2.7": LAYOUT, "2.8": LAYOUT, "2.9": LAYOUT, "perf": LAYOUT | {"irq_entry": "irq:irq_handler_entry", "irq_exit": "irq:irq_handler_exit", "sched_switch": "sched:sched_switch", "sched_wakeup": "sched:sched_wakeup", "softirq_entry": "irq:softirq_entry", "softirq_exit": "irq:softirq_exit", "softirq_raise": "irq:softirq_raise", "syscall_entry_prefix": "syscalls:sys_enter_", "syscall_exit_prefix": "syscalls:sys_exit_"}}


def status_of(prev_state: Column) -> Column:
    """Where a thread goes that leaves its CPU in a state."""
    s = prev_state.bitwiseAND(F.lit(STATE_MASK))
    has = lambda bit: s.bitwiseAND(F.lit(bit)) != 0
    return F.when(s == 0, WAIT_CPU).when(has(INTERRUPTIBLE | UNINTERRUPTIBLE), WAIT_BLOCKED).when(has(DEAD), NOT_ALIVE).otherwise(WAIT_UNKNOWN)


def state_changes(events: DataFrame, layout: dict[str, str] = LAYOUT) -> DataFrame:
    """(path, ts, seq, value) that kernel events make: threads' status, names and priorities, CPUs' thread and status."""
    t = F.col("type")

    def change(path: Sequence, value) -> Column:
        return F.struct(F.array(*[p if isinstance(p, Column) else F.lit(p) for p in path]).alias("path"), (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("value"))

    def thread(tid: Column, name: str, value) -> Column:
        key = F.when(tid == 0, F.concat(F.lit("0_"), F.col("cpu").cast("string"))).otherwise(tid.cast("string"))
        return change(["Threads", key, name], value)

    cpu = F.col("cpu").cast("string")
    nothing = F.array().cast("array<struct<path:array<string>,value:string>>")
    prev, nxt, tid = F.col("prev_tid"), F.col("next_tid"), F.col("tid")
    name = F.coalesce(F.col("next_comm"), F.lit(""))
    switch = F.array(
        thread(prev, "Status", status_of(F.col("prev_state"))), thread(nxt, "Status", RUN_USER), thread(nxt, "Exec_name", name), thread(nxt, "Prio", F.col("next_prio")), thread(nxt, "Current_cpu_rq", F.col("cpu")),
        change(["CPUs", cpu, "Current_thread"], nxt), change(["CPUs", cpu, "Status"], F.when(nxt == 0, "IDLE").otherwise(RUN_USER)),
    )
    entry, leave = t.startswith(layout["syscall_entry_prefix"]) | t.startswith(layout["compat_entry_prefix"]), t.startswith(layout["syscall_exit_prefix"])
    call = F.regexp_replace(t, f"^({layout['syscall_entry_prefix']}|{layout['compat_entry_prefix']})", "")
    made = (
        F.when(t == layout["sched_switch"], switch)
        .when(t.isin(layout["sched_wakeup"], layout["sched_waking"]), F.array(thread(tid, "Status", WAIT_CPU)))
        .when(t == layout["sched_process_fork"], F.array(thread(F.col("child_tid"), "Status", WAIT_CPU), thread(F.col("child_tid"), "PPID", F.col("parent_tid")), thread(F.col("child_tid"), "Exec_name", name)))
        .when(t == layout["sched_process_exit"], F.array(thread(tid, "Status", NOT_ALIVE)))
        .when(entry, F.array(thread(tid, "Status", RUN_SYSCALL), thread(tid, "System_call", call), change(["CPUs", cpu, "Status"], RUN_SYSCALL)))
        .when(leave, F.array(thread(tid, "Status", RUN_USER), thread(tid, "System_call", F.lit(None)), change(["CPUs", cpu, "Status"], RUN_USER)))
        .when(t == layout["irq_entry"], F.array(change(["CPUs", cpu, "IRQs", F.col("irq").cast("string")], F.col("cpu")), change(["CPUs", cpu, "Status"], "IRQ")))
        .when(t == layout["irq_exit"], F.array(change(["CPUs", cpu, "IRQs", F.col("irq").cast("string")], F.lit(None)), change(["CPUs", cpu, "Status"], RUN_USER)))
        .when(t == layout["softirq_raise"], F.array(change(["CPUs", cpu, "Soft_IRQs", F.col("irq").cast("string")], "RAISED")))
        .when(t == layout["softirq_entry"], F.array(change(["CPUs", cpu, "Soft_IRQs", F.col("irq").cast("string")], "RUNNING"), change(["CPUs", cpu, "Status"], "SOFTIRQ")))
        .when(t == layout["softirq_exit"], F.array(change(["CPUs", cpu, "Soft_IRQs", F.col("irq").cast("string")], F.lit(None)), change(["CPUs", cpu, "Status"], RUN_USER)))
        .when(t == "cpu_frequency", F.array(change(["CPUs", cpu, "Frequency"], F.col("frequency"))))
        .otherwise(nothing)
    )
    # An event's changes have an order, too: a switch of a thread to itself leaves the incoming status.
    return events.select("ts", "rank", F.posexplode(made).alias("__k", "__c")).select("__c.path", "ts", (F.col("rank") * 16 + F.col("__k")).alias("seq"), "__c.value")


def runs(switches: DataFrame, start: int, end: int) -> DataFrame:
    """(cpu, tid, start, end) of what ran where, from switches (ts, rank, cpu, prev_tid, next_tid).

    The first switch of a CPU closes a run that began with the trace; the last opens one that ends with it."""
    rows = global_lag(switches, "ts", ["ts", "rank"], None, ["ts"], "__", ["cpu"])
    closed = rows.select("cpu", F.col("prev_tid").alias("tid"), F.coalesce("__ts", F.lit(start)).alias("start"), F.col("ts").alias("end"))
    last = switches.groupBy("cpu").agg(F.max(F.struct("ts", "rank", "next_tid")).alias("s"))
    return closed.unionByName(last.select("cpu", F.col("s.next_tid").alias("tid"), F.col("s.ts").alias("start"), F.lit(end).cast("long").alias("end")))


def cpu_usage(found: DataFrame, low: int, high: int) -> DataFrame:
    """Time on CPU in [low, high] by CPU and thread, by CPU, by thread and in all (thread 0 idles and is left out)."""
    span = F.least(F.col("end"), F.lit(high)) - F.greatest(F.col("start"), F.lit(low))
    rows = found.where((F.col("tid") != 0) & (F.col("start") < high) & (F.col("end") > low)).withColumn("time", span)
    out = rows.cube("cpu", "tid").agg(F.sum("time").alias("time"), F.grouping_id().alias("level"))
    return out.withColumn("percent", 100.0 * F.col("time") / F.lit(high - low))


def cpu_usage_xy(found: DataFrame, times: Sequence[int], tids: Sequence[int] = ()) -> DataFrame:
    """Percent of each step between sample times that was spent on CPU, in all and of some threads."""
    points = sorted(set(times))
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in zip(points, points[1:])])
    rows = found.where((F.col("tid") != 0) & (F.col("start") < points[-1]) & (F.col("end") > points[0]))
    hit = F.filter(steps, lambda s: (s.a < F.col("end")) & (s.b > F.col("start")))
    rows = rows.withColumn("s", F.explode(hit)).withColumn("time", F.least("end", "s.b") - F.greatest("start", "s.a"))
    series = F.explode(F.array(F.lit("total"), *[F.when(F.col("tid") == t, F.lit(str(t))) for t in tids]))
    rows = rows.withColumn("series", series).where("series is not null")
    return rows.groupBy("series", F.col("s.b").alias("t")).agg((100.0 * F.sum("time") / F.first(F.col("s.b") - F.col("s.a"))).alias("percent"))


def context_switches(switches: DataFrame, low: int, high: int) -> DataFrame:
    return switches.where(F.col("ts").between(low, high)).rollup("cpu").agg(F.count("*").alias("n"))


def syscalls(events: DataFrame, layout: dict[str, str] = LAYOUT) -> DataFrame:
    """(tid, name, start, end, ret) of system calls."""
    t = F.col("type")
    prefix = f"^({layout['syscall_entry_prefix']}|{layout['compat_entry_prefix']})"
    begin, end = t.rlike(prefix), t.startswith(layout["syscall_exit_prefix"])
    return pair(events, ["tid"], begin, end, keep=["type"]).select("tid", F.regexp_replace("begin_type", prefix, "").alias("name"), "start", "end", "ret")


def wakeup_latency(events: DataFrame) -> DataFrame:
    """From a thread's wakeup to the switch to it. A row has (ts, rank, type, target): the woken or the next thread."""
    return pair(events, ["target"], F.col("type").isin("sched_wakeup", "sched_waking"), F.col("type") == "sched_switch").select("target", "start", "end", "prio")


def disk_requests(events: DataFrame) -> DataFrame:
    """(dev, sector, issued, completed, sectors, rw) of block requests."""
    found = pair(events, ["dev", "sector"], F.col("type") == "block_rq_issue", F.col("type") == "block_rq_complete", keep=["nr_sector", "rw"])
    return found.select("dev", "sector", F.col("start").alias("issued"), F.col("end").alias("completed"), F.col("begin_nr_sector").alias("sectors"), F.col("begin_rw").alias("rw"))


def sectors_at(requests: DataFrame, t: int) -> DataFrame:
    """Sectors moved by t: whole requests, and of those in flight the share of their time."""
    share = F.when(F.col("completed") <= t, 1.0).otherwise((t - F.col("issued")) / (F.col("completed") - F.col("issued")))
    return requests.where(F.col("issued") <= t).groupBy("dev", "rw").agg(F.sum(F.col("sectors") * share).alias("sectors"))


def page_memory(events: DataFrame, page_size: int = 4096) -> DataFrame:
    """Bytes of pages that each thread holds after each event, and the least ever."""
    from .matching import ledger

    pages = F.lit(page_size) * F.pow(F.lit(2), F.col("order")).cast("long")
    signed = F.when(F.col("type") == "kmem_mm_page_alloc", pages).when(F.col("type") == "kmem_mm_page_free", -pages).otherwise(F.lit(0).cast("long"))
    return ledger(events, ["tid"], signed)


def heap_memory(events: DataFrame) -> DataFrame:
    """Bytes that each thread holds: allocations by pointer, minus the size that a free of the pointer ends."""
    w = Window.partitionBy("ptr").orderBy("ts", "rank")
    free = F.col("type") == "free"
    sized = events.withColumn("__size", F.lag("size").over(w)).withColumn("__was", F.lag("type").over(w))
    amount = F.when(free, F.when(F.col("__was") != "free", -F.col("__size")).otherwise(F.lit(0))).otherwise(F.col("size"))
    out = sized.withColumn("amount", F.coalesce(amount, F.lit(0)))
    total = F.sum("amount").over(Window.partitionBy("tid").orderBy("ts", "rank").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("total", total).drop("__size", "__was")


def btf_changes(events: DataFrame) -> DataFrame:
    """(path, ts, seq, value) of task events: entities' states."""
    # State after each event.
    after = {"activate": "ACTIVE", "start": "RUNNING", "resume": "RUNNING", "suspend": "SUSPENDED", "terminate": None, "preempt": "READY", "release": "READY", "wait": "WAITING", "park": "PARKED", "poll": "POLLING", "run": "RUNNING"}
    known = F.create_map(*[F.lit(x) for k, v in after.items() if v for x in (k, v)])
    rows = events.where(F.col("event").isin(*after))
    return rows.select(F.array(F.col("target_type"), F.col("target"), F.col("target_instance").cast("string")).alias("path"), "ts", F.col("rank").alias("seq"), F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.col("event"))), F.lit(0)).alias("value"))
