"""Clock correction: linear transforms, and their estimate from packets that two hosts exchange."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ACCURATE, APPROXIMATE, INCOMPLETE, ABSENT, FAIL = "ACCURATE", "APPROXIMATE", "INCOMPLETE", "ABSENT", "FAIL"


@dataclass(frozen=True)
class Linear:
    """t -> alpha * t + beta, exact."""

    alpha: Fraction = Fraction(1)
    beta: Fraction = Fraction(0)

    def __call__(self, t: int) -> int:
        return int(self.alpha * t + self.beta)

    def after(self, first: Linear) -> Linear:
        """This transform of what `first` gives."""
        return Linear(self.alpha * first.alpha, self.alpha * first.beta + self.beta)

    def inverse(self) -> Linear:
        return Linear(1 / self.alpha, -self.beta / self.alpha)

    def column(self, c: Column) -> Column:
        """In decimals; identity and offsets stay in whole numbers."""
        if self.alpha == 1 and self.beta.denominator == 1:
            return c + int(self.beta)
        near = lambda x: F.lit(f"{float(x):.18f}").cast("decimal(38,18)")
        drift = self.alpha - 1  # small, so that the product keeps its digits
        return c + F.floor(c.cast("decimal(20,0)") * near(drift).cast("decimal(18,17)") + near(self.beta)).cast("long")


def hull(pairs: list[tuple[int, int, bool]]) -> tuple[Linear, str]:
    """The transform of host b's clock to a's from packets (time at a, time at b, from a to b).

    A packet from a to b bounds the line a = alpha * b + beta from below, one from b to a from above. The lower hull of
    the upper bounds and the upper hull of the lower bounds leave two extreme lines; their bisector is the estimate."""
    up = _hull(sorted((b, a) for a, b, forward in pairs if not forward), True)
    down = _hull(sorted((b, a) for a, b, forward in pairs if forward), False)
    if not up and not down:
        return Linear(), ABSENT
    if not up or not down:
        return Linear(), INCOMPLETE
    steep = flat = None
    for x0, y0 in down:
        for x1, y1 in up:
            if x0 == x1:
                if y0 > y1:
                    return Linear(), FAIL
                continue
            s = Fraction(y1 - y0, x1 - x0)
            if x1 > x0:
                steep = min(steep, (s, x0, y0)) if steep else (s, x0, y0)
            else:
                flat = max(flat, (s, x0, y0)) if flat else (s, x0, y0)
    if steep and flat:
        if flat[0] > steep[0]:
            return Linear(), FAIL
        alpha = (steep[0] + flat[0]) / 2
        beta = ((steep[2] - steep[0] * steep[1]) + (flat[2] - flat[0] * flat[1])) / 2
        return Linear(alpha, beta), ACCURATE
    gap = [y - x for x, y in up + down]
    return Linear(Fraction(1), Fraction(min(gap) + max(gap), 2)), APPROXIMATE


def _hull(points: list[tuple[int, int]], lower: bool) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in points:
        while len(out) > 1:
            (x0, y0), (x1, y1) = out[-2:]
            turn = (x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)
            if turn <= 0 if lower else turn >= 0:
                out.pop()
            else:
                break
        out.append(p)
    return out


def synchronise(matched: DataFrame) -> DataFrame:
    """(host_a, host_b, alpha, beta, quality) from matched packets (src_host, src_ts, dst_host, dst_ts).

    Of each host pair only the hulls matter, so each input partition keeps its own before the shuffle."""
    a, b = F.least("src_host", "dst_host"), F.greatest("src_host", "dst_host")
    forward = F.col("src_host") == a
    rows = matched.where("src_host <> dst_host").select(a.alias("host_a"), b.alias("host_b"), F.when(forward, F.col("src_ts")).otherwise(F.col("dst_ts")).alias("ta"), F.when(forward, F.col("dst_ts")).otherwise(F.col("src_ts")).alias("tb"), forward.alias("forward"))

    def thin(batches):
        kept: dict = {}
        for pdf in batches:
            for x, y, ta, tb, f in pdf.itertuples(index=False):
                kept.setdefault((x, y, f), []).append((tb, ta))
            for k in kept:
                if len(kept[k]) > 4096:
                    kept[k] = _hull(sorted(kept[k]), not k[2])
        rows = [(x, y, ta, tb, f) for (x, y, f), points in kept.items() for tb, ta in _hull(sorted(points), not f)]
        yield pd.DataFrame(rows, columns=["host_a", "host_b", "ta", "tb", "forward"])

    def fit(key, pdf):
        found, quality = hull([(int(r.ta), int(r.tb), bool(r.forward)) for r in pdf.itertuples()])
        return pd.DataFrame([(*key, str(found.alpha), str(found.beta), quality)], columns=["host_a", "host_b", "alpha", "beta", "quality"])

    schema = "host_a string, host_b string, ta long, tb long, forward boolean"
    return rows.mapInPandas(thin, schema).groupBy("host_a", "host_b").applyInPandas(fit, "host_a string, host_b string, alpha string, beta string, quality string")


def spanning_tree(found: list[tuple[str, str, Linear, str]], root: str) -> dict[str, Linear]:
    """Per-host transforms to the root's clock along the most accurate pairs (as many rows as host pairs)."""
    grade = {ACCURATE: 0, APPROXIMATE: 1}
    out = {root: Linear()}
    links = sorted((grade[q], a, b, t) for a, b, t, q in found if q in grade)
    grown = True
    while grown:
        grown = False
        for _, a, b, t in links:  # t takes b's time to a's
            if a in out and b not in out:
                out[b], grown = out[a].after(t), True
                break
            if b in out and a not in out:
                out[a], grown = out[b].after(t.inverse()), True
                break
    return out


def corrected(events: DataFrame, transforms: dict[str, Linear], host: str = "host", ts: str = "ts") -> DataFrame:
    out = F.col(ts)
    for h, t in transforms.items():
        if t != Linear():
            out = F.when(F.col(host) == h, t.column(F.col(ts))).otherwise(out)
    return events.withColumn(ts, out)


def to_nanoseconds(value: Column, scale: int) -> Column:
    """value * 10 ** scale seconds in nanoseconds, clamped."""
    from ..functions.scalars import saturated_multiply

    k = scale + 9
    return saturated_multiply(value, F.lit(10**k)) if k >= 0 else F.floor(value / F.lit(10**-k)).cast("long")


def cycles_to_ns(cycles: Column, frequency: int, offset: int = 0) -> Column:
    return F.lit(offset) + F.floor(cycles.cast("decimal(38,0)") * 1_000_000_000 / frequency).cast("long")


def periodic_markers(spark, reference: int, period: int, rollover: int, low: int, high: int) -> DataFrame:
    """(start, end, index) of a period's marks that meet [low, high]; the index returns to 0 after `rollover`."""
    first, last = (low - reference) // period, (high - reference) // period
    n = spark.range(first, last + 1)
    index = F.pmod(F.col("id"), F.lit(rollover)) if rollover else F.col("id")
    return n.select((F.lit(reference) + F.col("id") * period).alias("start"), (F.lit(reference) + (F.col("id") + 1) * period).alias("end"), index.alias("index"))
