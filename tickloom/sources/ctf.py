"""Common Trace Format 1.8: a metadata text declares types, streams and events; streams are files of bit-packed packets.

The metadata (of bounded size) is parsed on the driver; each stream file is a task. Rows are (trace, stream, cpu, rank,
ts, type, context, fields), context and fields as JSON. Discarded events become rows of type "lost"."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Magics of packets and of packeted metadata.
MAGIC, METADATA_MAGIC = 0xC1FC1FC1, 0x75D11D57


@dataclass(frozen=True)
class Int:
    size: int
    signed: bool = False
    align: int = 8
    order: str = "little"
    clock: str | None = None
    text: bool = False


@dataclass(frozen=True)
class Float:
    size: int
    align: int
    order: str


@dataclass(frozen=True)
class Text:
    align: int = 8


@dataclass(frozen=True)
class Enum:
    base: Int
    ranges: tuple

    @property
    def align(self):
        return self.base.align

    def label(self, v: int) -> str | None:
        return next((n for n, a, b in self.ranges if a <= v <= b), None)


@dataclass(frozen=True)
class Struct:
    fields: tuple
    least: int = 1

    @property
    def align(self):
        return max([self.least, *(t.align for _, t in self.fields)])


@dataclass(frozen=True)
class Array:
    kind: object
    length: object

    @property
    def align(self):
        return self.kind.align


@dataclass(frozen=True)
class Variant:
    tag: str
    options: tuple
    align: int = 1


@dataclass
class Metadata:
    order: str = "little"
    header: object = None
    env: dict = field(default_factory=dict)
    clocks: dict = field(default_factory=dict)
    streams: dict = field(default_factory=dict)
    events: dict = field(default_factory=dict)


# ---------------------------------------------------------------- declarations

_TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(\"(?:[^\"\\]|\\.)*\"|:=|\.\.\.|->|[A-Za-z_][A-Za-z0-9_]*|-?0[xX][0-9a-fA-F]+|-?[0-9]+(?:\.[0-9]+)?|[{}\[\]<>;:=,.()])", re.S)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"metadata: unexpected {text[at : at + 20]!r}")
        if m[1]:
            out.append(m[1])
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.t, self.at = tokens(text), 0
        self.out = Metadata()
        self.scopes: list[dict] = [{}]

    def peek(self, k: int = 0) -> str:
        return self.t[self.at + k] if self.at + k < len(self.t) else ""

    def next(self, want: str | None = None) -> str:
        got = self.peek()
        if want and got != want:
            raise ValueError(f"metadata: {want!r} is expected, not {got!r}")
        self.at += 1
        return got

    def named(self, name: str):
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        raise ValueError(f"metadata: no type {name!r}")

    def parse(self) -> Metadata:
        m = re.search(r"byte_order\s*=\s*(\w+)", " ".join(self.t))
        self.out.order = "big" if m and m[1] in ("be", "network") else "little"
        while self.peek():
            word = self.peek()
            if word in ("trace", "stream", "event", "env", "clock", "callsite") and self.peek(1) == "{":
                self.next()
                getattr(self, f"_{word}")(self.block())
            else:
                self.declaration()
        return self.out

    def block(self) -> dict:
        """name = value and name := type entries of a { ... }."""
        self.next("{")
        self.scopes.append({})
        found = {}
        while self.peek() != "}":
            if self.peek() in ("typealias", "typedef") or self.peek() in ("struct", "enum", "variant") and self.peek(1) not in ("{",) and self.peek(2) == "{":
                self.declaration()
                continue
            name = self.next()
            while self.peek() == ".":
                self.next()
                name += "." + self.next()
            if self.next() == ":=":
                found[name] = self.type()
            else:
                found[name] = self.value()
            self.next(";")
        self.next("}")
        self.scopes.pop()
        if self.peek() == ";":
            self.next()
        return found

    def value(self):
        parts = []
        while self.peek() not in (";", "}", ""):
            parts.append(self.next())
        text = "".join(parts)
        if text.startswith('"'):
            return json.loads(text)
        return int(text, 0) if re.fullmatch(r"-?(0[xX][0-9a-fA-F]+|[0-9]+)", text) else text

    def declaration(self) -> None:
        if self.peek() in ("typealias", "typedef"):
            alias = self.next() == "typealias"
            kind = self.type()
            if alias:
                self.next(":=")
            name = self.next()
            while self.peek() not in (";", "["):
                name += " " + self.next()
            kind = self.lengths(kind)
            self.scopes[-1][name] = kind
        else:
            self.type()
        self.next(";")

    def lengths(self, kind):
        sizes = []
        while self.peek() == "[":
            self.next()
            path = ""
            while self.peek() != "]":
                path += self.next()
            self.next("]")
            sizes.append(int(path, 0) if re.fullmatch(r"[0-9xXa-fA-F]+", path) and path[0].isdigit() else path)
        for n in reversed(sizes):
            kind = Array(kind, n)
        return kind

    def settings(self) -> dict:
        found = {}
        self.next("{")
        while self.peek() != "}":
            name = self.next()
            self.next("=")
            found[name] = self.value()
            self.next(";")
        self.next("}")
        return found

    def _order(self, s: dict) -> str:
        v = s.get("byte_order", "native")
        return {"le": "little", "be": "big", "network": "big"}.get(v, self.out.order)

    def type(self):
        word = self.next()
        if word == "integer":
            s = self.settings()
            clock = re.match(r"clock\.(\w+)\.value", str(s.get("map", "")))
            return Int(s["size"], s.get("signed") in ("true", 1, "TRUE"), s.get("align", 8 if s["size"] % 8 == 0 else 1), self._order(s), clock[1] if clock else None, str(s.get("encoding", "none")).lower() in ("utf8", "ascii"))
        if word == "floating_point":
            s = self.settings()
            return Float(s.get("exp_dig", 8) + s.get("mant_dig", 24), s.get("align", 8), self._order(s))
        if word == "string":
            if self.peek() == "{":
                self.settings()
            return Text()
        if word == "enum":
            name = self.next() if self.peek() not in (":", "{") else None
            if self.peek() not in (":", "{"):
                return self.named(f"enum {name}")
            base = Int(32, align=8, order=self.out.order)
            if self.peek() == ":":
                self.next()
                base = self.type()
            self.next("{")
            ranges, n = [], 0
            while self.peek() != "}":
                label = self.next().strip('"')
                if self.peek() == "=":
                    self.next()
                    low = high = int(self.next(), 0)
                    if self.peek() == "...":
                        self.next()
                        high = int(self.next(), 0)
                else:
                    low = high = n
                ranges.append((label, low, high))
                n = high + 1
                if self.peek() == ",":
                    self.next()
            self.next("}")
            return self.keep("enum", name, Enum(base, tuple(ranges)))
        if word in ("struct", "variant"):
            name = self.next() if self.peek() not in ("{", "<") else None
            tag = None
            if self.peek() == "<":
                self.next()
                tag = ""
                while self.peek() != ">":
                    tag += self.next()
                self.next(">")
            if self.peek() != "{":
                known = self.named(f"{word} {name}")
                return Variant(tag, known.options) if word == "variant" and tag else known
            fields = self.members()
            least = 1
            if self.peek() == "align":
                self.next()
                self.next("(")
                least = int(self.next(), 0)
                self.next(")")
            return self.keep(word, name, Struct(fields, least) if word == "struct" else Variant(tag or "", fields))
        while True:  # names of several words, such as "unsigned long"
            try:
                return self.named(word)
            except ValueError:
                if not re.match(r"[A-Za-z_]", self.peek() or "") or self.peek(1) in (";", "[", ":="):
                    raise
                word += " " + self.next()

    def keep(self, word: str, name: str | None, kind):
        if name:
            self.scopes[-1][f"{word} {name}"] = kind
        return kind

    def members(self) -> tuple:
        self.next("{")
        self.scopes.append({})
        out = []
        while self.peek() != "}":
            if self.peek() in ("typealias", "typedef"):
                self.declaration()
                continue
            kind = self.type()
            if self.peek() == ";":
                self.next()
                continue
            name = self.next()
            out.append((name.removeprefix("_") if name.startswith("_") else name, self.lengths(kind)))
            self.next(";")
        self.next("}")
        self.scopes.pop()
        return tuple(out)

    def _trace(self, b):
        self.out.header = b.get("packet.header")

    def _stream(self, b):
        self.out.streams[b.get("id", 0)] = b

    def _event(self, b):
        self.out.events[b.get("stream_id", 0), b.get("id", 0)] = b

    def _env(self, b):
        self.out.env |= b

    def _clock(self, b):
        self.out.clocks[b.get("name")] = b

    def _callsite(self, b):
        pass


def metadata_text(raw: bytes) -> str:
    """Plain metadata, or the text of packeted metadata."""
    for order in ("<", ">"):
        if len(raw) >= 4 and struct.unpack(order + "I", raw[:4])[0] == METADATA_MAGIC:
            out, at = [], 0
            while at + 37 <= len(raw):
                content, size = struct.unpack(order + "II", raw[at + 24 : at + 32])
                out.append(raw[at + 37 : at + content // 8])
                at += max(size // 8, 37)
            return b"".join(out).decode("utf-8", "replace").rstrip("\0")
    return raw.decode("utf-8", "replace")


# ---------------------------------------------------------------- values


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def align(self, n: int) -> None:
        if n > 1:
            self.at = -(-self.at // n) * n

    def integer(self, k: Int) -> int:
        self.align(k.align)
        first, last = self.at // 8, -(-(self.at + k.size) // 8)
        if last > len(self.data):
            raise EOFError
        v = int.from_bytes(self.data[first:last], k.order)
        low = self.at - 8 * first
        v >>= low if k.order == "little" else 8 * (last - first) - low - k.size
        v &= (1 << k.size) - 1
        self.at += k.size
        return v - (1 << k.size) if k.signed and v >> (k.size - 1) else v

    def read(self, k, scopes: list[dict]):
        if isinstance(k, Int):
            return self.integer(k)
        if isinstance(k, Enum):
            v = self.integer(k.base)
            return {"value": v, "label": k.label(v)}
        if isinstance(k, Float):
            v = self.integer(Int(k.size, False, k.align, k.order))
            return struct.unpack(">f" if k.size == 32 else ">d", v.to_bytes(k.size // 8, "big"))[0]
        if isinstance(k, Text):
            self.align(8)
            end = self.data.find(b"\0", self.at // 8)
            if end < 0:
                raise EOFError
            text = self.data[self.at // 8 : end].decode("utf-8", "replace")
            self.at = 8 * (end + 1)
            return text
        if isinstance(k, Struct):
            self.align(k.align)
            out: dict = {}
            for name, kind in k.fields:
                out[name] = self.read(kind, [*scopes, out])
            return out
        if isinstance(k, Array):
            n = k.length if isinstance(k.length, int) else int(lookup(scopes, k.length))
            values = [self.read(k.kind, scopes) for _ in range(n)]
            if isinstance(k.kind, Int) and k.kind.text and k.kind.size == 8:
                return bytes(v & 255 for v in values).split(b"\0")[0].decode("utf-8", "replace")
            return values
        tag = lookup(scopes, k.tag)
        label = tag["label"] if isinstance(tag, dict) else tag
        return self.read(dict(k.options)[label], scopes)


def lookup(scopes: list[dict], path: str):
    """A field by its path's last names, from the innermost scope out."""
    parts = [p.removeprefix("_") for p in path.split(".")]
    for k in range(len(parts)):
        for scope in reversed(scopes):
            v = scope
            for p in parts[k:]:
                v = v.get(p) if isinstance(v, dict) else None
                if v is None:
                    break
            if v is not None:
                return v
    raise ValueError(f"no field {path}")


def _plain(v):
    if isinstance(v, dict) and set(v) == {"value", "label"}:
        return v["label"] if v["label"] is not None else v["value"]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _number(v):
    return v["value"] if isinstance(v, dict) else v


def _clock_fields(kind) -> list[tuple[str, Int]]:
    """Names of integers that a clock maps, in a structure and what it holds."""
    out = []
    for name, k in getattr(kind, "fields", getattr(kind, "options", ())):
        k = k.base if isinstance(k, Enum) else k
        if isinstance(k, Int):
            out += [(name, k)] if k.clock or name in ("timestamp", "timestamp_begin") else []
        elif isinstance(k, (Struct, Variant)):
            out += _clock_fields(k)
    return out


def _find(v, name):
    """The first value of a name in nested structures."""
    if isinstance(v, dict):
        if name in v and not isinstance(v[name], dict):
            return v[name]
        for x in v.values():
            if (found := _find(x, name)) is not None:
                return found
    return None


def events(meta: Metadata, data: bytes) -> Iterator[tuple]:
    """(stream, cpu, ts, type, context, fields) of a stream file. A cut last packet ends it."""
    at, before = 0, {}
    while at < len(data):
        bits = Bits(data, 8 * at)
        try:
            head = bits.read(meta.header, []) if meta.header else {}
            if "magic" in head and head["magic"] != MAGIC:
                raise ValueError(f"no packet at byte {at}")
            sid = _number(head.get("stream_id", 0))
            stream = meta.streams[sid]
            packet = bits.read(stream["packet.context"], [head]) if "packet.context" in stream else {}
        except EOFError:
            return
        content = at * 8 + packet.get("content_size", 8 * (len(data) - at))
        size = packet.get("packet_size", 8 * (len(data) - at)) // 8
        body = Bits(data[: min(len(data), -(-content // 8))], bits.at)
        cpu, clock = packet.get("cpu_id"), packet.get("timestamp_begin", 0)
        own = next(iter(meta.clocks.values()), {})
        ns = lambda c: own.get("offset_s", 0) * 10**9 + (c + own.get("offset", 0)) * 10**9 // own.get("freq", 10**9)
        lost = packet.get("events_discarded", 0)
        if lost > before.get((sid, cpu), 0):
            yield sid, cpu, ns(clock), "lost", "{}", json.dumps({"count": lost - before.get((sid, cpu), 0), "end": ns(packet.get("timestamp_end", clock))})
        before[sid, cpu] = lost
        header = stream.get("event.header")
        stamps = _clock_fields(header) if header else []
        while body.at < content:
            try:
                h = body.read(header, [head, packet]) if header else {}
                kind = _number(lookup([h], "id")) if header and "id" in h else 0
                if isinstance(h.get("v"), dict) and "id" in h["v"]:
                    kind = h["v"]["id"]
                for name, k in stamps:
                    if (v := _find(h, name)) is not None:
                        k = next((x for n, x in stamps if n == name and (v < 1 << x.size)), k) if not isinstance(h.get("v"), dict) else (k if len(stamps) == 1 else stamps[0][1] if "id" not in h["v"] else stamps[-1][1])
                        if k.size < 64:
                            low = clock & ((1 << k.size) - 1)
                            v = clock - low + v + ((1 << k.size) if v < low else 0)
                        clock = v
                        break
                event = meta.events[sid, kind]
                context = {}
                for part in (stream.get("event.context"), event.get("context")):
                    context |= body.read(part, [head, packet, h]) if part else {}
                values = body.read(event["fields"], [head, packet, h, context]) if "fields" in event else {}
            except EOFError:
                break
            yield sid, cpu, ns(clock), event.get("name"), json.dumps(_plain(context)), json.dumps(_plain(values))
        if size <= 0:
            return
        at += size


ROW = "trace string, stream long, cpu long, rank long, ts long, type string, context string, fields string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events of a trace folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    texts = files.where(name == "metadata").select("content").collect()
    if len(texts) != 1:
        raise ValueError(f"{path} holds {len(texts)} metadata files")
    meta = spark.sparkContext.broadcast(Parser(metadata_text(bytes(texts[0].content))).parse())
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 3]
    names = [x.split()[0] for x in ROW.split(", ")]

    def decode(batches):
        for batch in batches:
            for trace, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for rank, (sid, cpu, *rest) in enumerate(events(meta.value, data.as_py())):
                    rows.append((trace, sid, cpu, rank, *rest))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.where((name != "metadata") & ~name.startswith(".")).select("path", "content").mapInArrow(decode, ROW)
