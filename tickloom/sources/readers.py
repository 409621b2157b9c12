"""Readers of trace and log formats as event DataFrames. Each file is one or more tasks; nothing is read on the driver
but the few bytes that name a format."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


# ---------------------------------------------------------------- text


def text_events(spark: SparkSession, path: str, head: str, fields: Sequence[str], time_format: str | None = None, time_field: str | None = None) -> DataFrame:
    """Lines that match `head` begin events whose groups are the fields; lines up to the next head belong to the event.

    Lines are numbered within their file (line offset order), so continuation lines are a running count of heads by file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("trace"), F.monotonically_increasing_id().alias("__line"), "value")
    w = Window.partitionBy("trace").orderBy("__line")
    rows = raw.withColumn("__head", F.col("value").rlike(head)).withColumn("rank", F.sum(F.col("__head").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("rank >= 0")
    grouped = rows.groupBy("trace", "rank").agg(F.min_by("value", "__line").alias("first"), F.array_sort(F.collect_list(F.struct("__line", "value"))).alias("lines"))
    parts = [F.regexp_extract("first", head, k + 1).alias(name) for k, name in enumerate(fields)]
    out = grouped.select("trace", "rank", *parts, F.array_join(F.transform("lines", lambda x: x.value), "\n").alias("text"))
    if time_format and time_field:
        out = out.withColumn("ts", F.unix_micros(F.try_to_timestamp(F.col(time_field), F.lit(time_format))))
    return out


def tagged(rows: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Columns by tag: IGNORE drops, MESSAGE and EVENT_TYPE rename, OTHER goes to the map `fields`."""
    other = [c for c, t in tags.items() if t == "OTHER"]
    keep = [F.col(c).alias({"MESSAGE": "message", "EVENT_TYPE": "type", "TIMESTAMP": "ts"}[t]) for c, t in tags.items() if t in ("MESSAGE", "EVENT_TYPE", "TIMESTAMP")]
    extra = F.map_filter(F.create_map(*[x for c in other for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if other else F.create_map().cast("map<string,string>")
    return rows.select(*[c for c in ("trace", "rank") if c in rows.columns], *keep, extra.alias("fields"))


def extra_fields(names: Column, values: Column) -> Column:
    """Name/value pairs of EXTRA_FIELD tags as a map; a repeated name keeps its last value."""
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    return F.map_from_entries(F.filter(pairs, lambda p: F.exists(pairs, lambda q: q.k == p.k)))


# ---------------------------------------------------------------- structured text


def json_events(spark: SparkSession, path: str, schema, time_key: str, multi_line: bool = False) -> DataFrame:
    """JSON events with a rank in time order (sorting spills; no chunk files are kept)."""
    rows = spark.read.schema(schema).json(path, multiLine=multi_line) if schema else spark.read.json(path, multiLine=multi_line)
    return rows.withColumn("ts", F.col(time_key).cast("long"))


def xml_events(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


BTF_SCHEMA = "ts_raw string, source string, source_instance string, target_type string, target string, target_instance string, event string, note string"


def btf_events(spark: SparkSession, path: str, scale: int = 1) -> DataFrame:
    """Best Trace Format: #-lines are headers; ts is scaled to nanoseconds."""
    rows = spark.read.schema(BTF_SCHEMA).csv(path, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.where(F.col("ts_raw").rlike("^[0-9]+$"))
    return rows.select((F.col("ts_raw").cast("long") * scale).alias("ts"), F.monotonically_increasing_id().alias("rank"), "source", F.col("source_instance").cast("long").alias("source_instance"), "target_type", "target", F.col("target_instance").cast("long").alias("target_instance"), "event", "note")


def btf_scale(spark: SparkSession, path: str) -> int:
    """Nanoseconds a unit, from the header line #timeScale."""
    found = spark.read.text(path).where(F.lower("value").startswith("#timescale")).limit(1).collect()
    unit = found[0].value.split()[-1].lower() if found else "ns"
    return {"ps": 1, "ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9}[unit]


# ---------------------------------------------------------------- packets

# Link, network and transport numbers, and capture magics.
LINK_ETHERNET, ETHER_IPV4, ETHER_IPV6, IP_TCP, IP_UDP = 1, 0x0800, 0x86DD, 6, 17
PCAP_MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1)}
PACKET = "trace string, rank long, ts long, length int, captured int, protocols array<string>, src_mac string, dst_mac string, src string, dst string, src_port int, dst_port int, seq long, ack long, flags int, payload binary"


def dissect(data: bytes, link: int = LINK_ETHERNET) -> dict:
    """Ethernet II, IPv4 or IPv6, TCP or UDP; the rest is payload. A truncated layer ends the dissection."""
    out = {"protocols": [], "src_mac": None, "dst_mac": None, "src": None, "dst": None, "src_port": None, "dst_port": None, "seq": None, "ack": None, "flags": None, "payload": data}
    if link != LINK_ETHERNET or len(data) < 14:
        out["protocols"].append("UNKNOWN")
        return out
    out["protocols"].append("ETHERNET_II")
    out["dst_mac"], out["src_mac"] = (":".join(f"{b:02x}" for b in data[k : k + 6]) for k in (0, 6))
    kind, rest = int.from_bytes(data[12:14], "big"), data[14:]
    out["payload"] = rest
    if kind == ETHER_IPV4 and len(rest) >= 20 and rest[0] >> 4 == 4 and (head := (rest[0] & 15) * 4) >= 20 and len(rest) >= head:
        out["protocols"].append("IPV4")
        total = int.from_bytes(rest[2:4], "big")
        out["src"], out["dst"] = (".".join(map(str, rest[k : k + 4])) for k in (12, 16))
        number, rest = rest[9], rest[head : max(head, total)] if total else rest[head:]
    elif kind == ETHER_IPV6 and len(rest) >= 40:
        out["protocols"].append("IPV6")
        out["src"], out["dst"] = (":".join(f"{int.from_bytes(rest[k + i : k + i + 2], 'big'):x}" for i in range(0, 16, 2)) for k in (8, 24))
        number, rest = rest[6], rest[40:]
    else:
        out["protocols"].append("UNKNOWN")
        return out
    out["payload"] = rest
    if number == IP_TCP and len(rest) >= 20:
        out["protocols"].append("TCP")
        out["src_port"], out["dst_port"], out["seq"], out["ack"] = struct.unpack(">HHII", rest[:12])
        out["flags"], out["payload"] = rest[13], rest[(rest[12] >> 4) * 4 :]
    elif number == IP_UDP and len(rest) >= 8:
        out["protocols"].append("UDP")
        out["src_port"], out["dst_port"] = struct.unpack(">HH", rest[:4])
        out["payload"] = rest[8:]
    else:
        out["protocols"].append("UNKNOWN")
    return out


def pcap_records(data: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """(ts in ns, original length, bytes, link type) of a libpcap or pcapng capture. A cut last record ends it."""
    if data[:4] in PCAP_MAGIC:
        order, unit = PCAP_MAGIC[data[:4]]
        link = struct.unpack(order + "I", data[20:24])[0]
        at = 24
        while at + 16 <= len(data):
            sec, sub, kept, size = struct.unpack(order + "IIII", data[at : at + 16])
            if at + 16 + kept > len(data):
                return
            yield sec * 10**9 + sub * unit, size, data[at + 16 : at + 16 + kept], link
            at += 16 + kept
        return
    at, order, links = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order, links = ("<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack(order + "II", data[at : at + 8])
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            unit, k = 1000, 8
            while k + 4 <= len(body):
                code, n = struct.unpack(order + "HH", body[k : k + 4])
                if code == 0:
                    break
                if code == 9:
                    r = body[k + 4]
                    unit = 10 ** (9 - r) if r <= 9 else -(1 << (r & 127))
                k += 4 + (n + 3) // 4 * 4
            links.append((struct.unpack(order + "H", body[:2])[0], unit))
        elif kind == 6 and links:
            i, high, low, kept, length = struct.unpack(order + "IIIII", body[:20])
            link, unit = links[i]
            t = high << 32 | low
            yield t * unit if unit > 0 else t * 10**9 // -unit, length, body[20 : 20 + kept], link
        elif kind == 3 and links:
            length = struct.unpack(order + "I", body[:4])[0]
            yield 0, length, body[4 : 4 + length], links[0][0]
        at += size


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of captures: a file is a task (captures are written in rotated files)."""
    names = [x.split()[0] for x in PACKET.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split()[1]] for x in PACKET.split(", ")]

    def read(batches):
        for batch in batches:
            for trace, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for rank, (ts, size, own, link) in enumerate(pcap_records(data.as_py())):
                    d = dissect(own, link)
                    rows.append((trace, rank, ts, size, len(own), *(d[n] for n in names[5:])))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, PACKET)


def with_protocol(found: DataFrame, protocol: str) -> DataFrame:
    return found.where(F.array_contains("protocols", protocol))


# ---------------------------------------------------------------- reports, detection, experiments


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """(class, row, cells) of an external analysis's JSON report: results[].{class, data[][]}, cells as JSON text."""
    text = spark.read.text(path, wholetext=True)
    result = F.explode(F.from_json(F.get_json_object("value", "$.results"), "array<struct<class:string,data:array<array<string>>>>"))
    rows = text.select(result.alias("r")).select(F.col("r.class").alias("class"), F.posexplode("r.data").alias("row", "cells"))
    return rows


def detect(head: bytes) -> list[tuple[str, int]]:
    """(format, confidence) of the first bytes of a file, the best first."""
    found = []
    if head[:4] in PCAP_MAGIC:
        found.append(("pcap", 100))
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        found.append(("pcapng", 100))
    if head[:4] in (b"\xc1\x1f\xfc\xc1", b"\xc1\xfc\x1f\xc1"):
        found.append(("ctf", 100))
    text = head.decode("utf-8", "replace")
    if re.match(r"#version", text, re.I):
        found.append(("btf", 80))
    if re.match(r"\s*<\?xml|\s*<[A-Za-z]", text):
        found.append(("xml", 40))
    if re.match(r"\s*[\[{]", text):
        found.append(("json", 50))
    if text and "\x00" not in text and "�" not in text[:200]:
        found.append(("text", 10))
    return sorted(found, key=lambda x: -x[1])


def experiment(*traces: DataFrame) -> DataFrame:
    """Traces merged: rows in (ts, trace, rank) order are one total order, ties by the trace's place."""
    out = None
    for k, t in enumerate(traces):
        one = t.withColumn("trace_index", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def from_rank(events: DataFrame, rank: int) -> DataFrame:
    return events.where(F.col("rank") >= rank)


def from_time(events: DataFrame, ts: int) -> DataFrame:
    return events.where(F.col("ts") >= ts)


def from_ratio(events: DataFrame, ratio: float) -> DataFrame:
    """By the share of the events: the rank bound is one aggregated row."""
    bound = events.agg(F.floor((F.max("rank") - F.min("rank") + 1) * ratio + F.min("rank")).alias("__r"))
    return events.crossJoin(F.broadcast(bound)).where("rank >= __r").drop("__r")


def trimmed(events: DataFrame, low: int, high: int) -> DataFrame:
    return events.where(F.col("ts").between(low, high))


def write_history(found: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Intervals as Parquet, clustered by key and start, so that queries by key or time skip row groups."""
    found.repartitionByRange(*keys, "start").sortWithinPartitions(*keys, "start").write.mode("overwrite").parquet(path)
