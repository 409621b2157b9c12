"""Declarative analyses: handlers, conditions and state changes as data; patterns as finite state machines.

A definition is plain data (also read from XML by `from_xml`). State changes compile to Columns and one explode;
state machines run one scenario key at a time, since their steps depend on each other."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def name_matches(pattern: str) -> Column:
    """Event names with * as a wildcard."""
    if "*" not in pattern:
        return F.col("type") == pattern
    return F.col("type").rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")


def value(spec, groups: dict[str, dict] | None = None) -> Column:
    """{'constant': v}, {'field': name}, {'eventName': true}, {'null': true}, with optional 'type' and 'group'."""
    if not isinstance(spec, dict):
        spec = {"constant": spec}
    if "field" in spec:
        out = F.col(spec["field"])
    elif spec.get("eventName"):
        out = F.col("type")
    elif spec.get("null"):
        out = F.lit(None)
    else:
        out = F.lit(spec["constant"])
    if "group" in spec and groups:
        pairs = [F.lit(str(x)) for kv in groups[spec["group"]].items() for x in kv]
        out = F.coalesce(F.element_at(F.create_map(*pairs), out.cast("string")), out.cast("string"))
    if "type" in spec:
        out = out.try_cast({"int": "int", "long": "long", "string": "string", "double": "double"}[spec["type"]])
    return out


_OPS = {"eq": "=", "ne": "<>", "ge": ">=", "gt": ">", "le": "<=", "lt": "<"}


def condition(spec: dict | None) -> Column:
    """{'and': [...]}, {'or': [...]}, {'not': c}, {'compare': op, 'left': v, 'right': v}, {'regex': r, 'value': v}, {'in': [a, b]}, {'out': [a, b]}.

    Both sides compare as whole numbers where they are, else as text."""
    if not spec:
        return F.lit(True)
    if "and" in spec:
        return reduce(Column.__and__, map(condition, spec["and"]))
    if "or" in spec:
        return reduce(Column.__or__, map(condition, spec["or"]))
    if "not" in spec:
        return ~condition(spec["not"])
    if "regex" in spec:
        return F.coalesce(value(spec["value"]).cast("string").rlike(spec["regex"]), F.lit(False))
    if "in" in spec:
        return F.col("ts").between(*spec["in"])
    if "out" in spec:
        return ~F.col("ts").between(*spec["out"])
    a, b, op = value(spec["left"]).cast("string"), value(spec["right"]).cast("string"), spec["compare"]
    x, y = a.try_cast("long"), b.try_cast("long")
    test = {"eq": lambda p, q: p == q, "ne": lambda p, q: p != q, "ge": lambda p, q: p >= q, "gt": lambda p, q: p > q, "le": lambda p, q: p <= q, "lt": lambda p, q: p < q}[op]
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(a, b)), F.lit(False))


@dataclass
class Change:
    """A state change: the attribute's path, its value, what to do with it, and when."""

    path: list
    value: object = None
    op: str = "modify"
    when: dict | None = None
    otherwise: Change | None = None
    after: object = None


@dataclass
class Handler:
    event: str
    changes: list[Change] = field(default_factory=list)


@dataclass
class Definition:
    handlers: list[Handler]
    locations: dict[str, list] = field(default_factory=dict)
    groups: dict[str, dict] = field(default_factory=dict)

    def path(self, parts: Sequence) -> Column:
        flat: list = []
        for p in parts:
            flat += self.locations[p["location"]] if isinstance(p, dict) and "location" in p else [p]
        return F.array(*[value(p, self.groups).cast("string") for p in flat])

    def _one(self, c: Change, where: Column) -> list[tuple[Column, Change]]:
        test = condition(c.when)
        out = [(where & test, c)]
        return out + (self._one(c.otherwise, where & ~test) if c.otherwise else [])

    def changes(self, events: DataFrame) -> DataFrame:
        """(path, ts, seq, op, value): one pass over the events; events no handler names are filtered first."""
        made, names = [], []
        for h in self.handlers:
            names.append(name_matches(h.event))
            for c in h.changes:
                for where, own in self._one(c, names[-1]):
                    late = value(own.after).cast("long") if own.after is not None else F.col("ts")
                    row = F.struct(self.path(own.path).alias("path"), late.alias("ts"), F.lit(len(made)).alias("k"), F.lit(own.op).alias("op"), value(own.value if own.value is not None else {"null": True}, self.groups).cast("string").alias("value"))
                    made.append(F.when(where, row))
        rows = events.where(reduce(Column.__or__, names)).withColumn("__c", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())))
        return rows.select("__c.path", "__c.ts", (F.col("rank") * len(made) + F.col("__c.k")).alias("seq"), "__c.op", "__c.value")


def from_xml(text: str) -> Definition:
    """A definition from XML: stateProvider/location, mappingGroup, eventHandler/stateChange with stateAttribute and stateValue."""
    root = ET.fromstring(text)

    def attribute(e) -> object:
        kind, v = e.get("type"), e.get("value")
        return {"constant": lambda: v, "eventField": lambda: {"field": v}, "eventName": lambda: {"eventName": True}, "location": lambda: {"location": v}, "null": lambda: {"null": True}}[kind]()

    def state_value(e) -> object:
        kind, v = e.get("type"), e.get("value")
        out = {"int": lambda: {"constant": int(v)}, "long": lambda: {"constant": int(v)}, "string": lambda: {"constant": v}, "eventField": lambda: {"field": v}, "eventName": lambda: {"eventName": True}, "null": lambda: {"null": True}, "delete": lambda: {"null": True}}[kind]()
        if e.get("forcedType"):
            out["type"] = e.get("forcedType")
        if e.get("mappingGroup"):
            out["group"] = e.get("mappingGroup")
        return out

    def test(e) -> dict:
        kids = [test(c) for c in e if c.tag in ("and", "or", "not", "condition")]
        if e.tag in ("and", "or"):
            return {e.tag: kids}
        if e.tag == "not":
            return {"not": kids[0]}
        if e.tag == "if":
            return kids[0]
        left, right = [state_value(c) if c.tag == "stateValue" else attribute(c) for c in e][:2]
        return {"compare": e.get("operator", "eq"), "left": left, "right": right}

    def change(e) -> Change:
        if (gate := e.find("if")) is not None:
            yes, no = e.find("then"), e.find("else")
            out = change(yes)
            out.when = test(gate)
            out.otherwise = change(no) if no is not None else None
            return out
        v = e.find("stateValue")
        op = "increment" if v.get("increment") == "true" else "update" if v.get("update") == "true" else v.get("stack") or ("delete" if v.get("type") == "delete" else "modify")
        return Change([attribute(a) for a in e.findall("stateAttribute")], state_value(v), op)

    provider = root if root.tag == "stateProvider" else root.find(".//stateProvider")
    return Definition(
        [Handler(h.get("eventName"), [change(c) for c in h.findall("stateChange")]) for h in provider.findall("eventHandler")],
        {x.get("id"): [attribute(a) for a in x.findall("stateAttribute")] for x in provider.findall("location")},
        {g.get("id"): {state: e.get("value") for e in g.findall("entry") for state in [e.find("stateValue").get("value")]} for g in provider.findall("mappingGroup")},
    )


# ---------------------------------------------------------------- patterns


@dataclass
class Transition:
    source: str
    target: str
    events: Sequence[str]
    when: dict[str, object] = field(default_factory=dict)
    store: Sequence[str] = ()
    same: Sequence[str] = ()
    clear: bool = False


@dataclass
class Machine:
    """A pattern. Several scenarios may be active; a consuming machine gives an event to the first that accepts it."""

    initial: str
    final: str
    transitions: Sequence[Transition]
    multiple: bool = True
    consuming: bool = True
    abandon: Sequence[str] = ()

    def run(self, events) -> list[dict]:
        """Scenarios of dicts of events in order: status, start, end, states' times and stored fields."""
        done, active = [], []
        for e in events:
            taken = False
            for s in list(active):
                if s["state"] in self.abandon and e["type"] in self.abandon:
                    continue
                if (t := self._accept(s, e)) is not None:
                    self._move(s, t, e)
                    taken = True
                    if s["state"] == self.final:
                        s["status"] = "MATCHED"
                        active.remove(s)
                        done.append(s)
                    elif e["type"] in self.abandon:
                        s["status"] = "ABANDONED"
                        active.remove(s)
                        done.append(s)
                    if self.consuming:
                        break
            if (not taken or not self.consuming) and (self.multiple or not active):
                s = {"state": self.initial, "status": "PENDING", "start": None, "end": None, "times": [], "stored": {}}
                if (t := self._accept(s, e)) is not None:
                    s["start"] = e["ts"]
                    self._move(s, t, e)
                    (done if s["state"] == self.final else active).append(s)
                    s["status"] = "MATCHED" if s["state"] == self.final else "IN_PROGRESS"
        return done + active

    def _accept(self, s, e):
        for t in self.transitions:
            if t.source == s["state"] and e["type"] in t.events and all(e.get(k) == v for k, v in t.when.items()) and all(s["stored"].get(k) == str(e.get(k)) for k in t.same):
                return t
        return None

    def _move(self, s, t, e):
        s["state"], s["end"] = t.target, e["ts"]
        s["times"].append((t.target, e["ts"]))
        if t.clear:
            s["stored"].clear()
        s["stored"].update({k: str(e.get(k)) for k in t.store})


SCENARIO = "status string, state string, start long, end long, times array<struct<state:string,ts:long>>, stored map<string,string>"


def scenarios(events: DataFrame, machine: Machine, keys: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """Scenarios of each key's events; only the events that a transition names leave the scan."""
    names = sorted({x for t in machine.transitions for x in t.events} | set(machine.abandon))
    own = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    columns = list(dict.fromkeys([*keys, "ts", "rank", "type", *fields]))

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = machine.run(pdf.sort_values(["ts", "rank"]).to_dict("records"))
        rows = [(*key, s["status"], s["state"], s["start"], s["end"], [{"state": a, "ts": b} for a, b in s["times"]], s["stored"]) for s in found]
        return pd.DataFrame(rows, columns=[*keys, "status", "state", "start", "end", "times", "stored"])

    return events.where(F.col("type").isin(names)).select(*columns).groupBy(*keys).applyInPandas(walk, f"{own}, {SCENARIO}")


def pattern_segments(found: DataFrame, name: str) -> DataFrame:
    """Matched scenarios as segments."""
    return found.where("status = 'MATCHED'").select(F.lit(name).alias("name"), "start", "end", "stored")
