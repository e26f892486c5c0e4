"""Counters, gauges and histograms over observations, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exponential_bounds(start: float, factor: float, count: int) -> list[float]:
    """start, start factor, ...: by repeated multiplication, so that equal bounds are equal numbers."""
    out = [start]
    for _ in range(count - 1):
        out.append(out[-1] * factor)
    return out


def histogram(obs: DataFrame, bounds: list[float], *by: str) -> DataFrame:
    """(by, le, n): cumulative counts of values up to each bound, the bound included; le is null for all."""
    cells = F.array(*(F.struct(F.lit(b).alias("le"), F.count_if(F.col("value") <= b).alias("n")) for b in bounds), F.struct(F.lit(None).cast("double").alias("le"), F.count("value").alias("n")))
    return obs.groupBy(*by).agg(cells.alias("cells")).select(*by, F.inline("cells"))


def totals(obs: DataFrame, *by: str) -> DataFrame:
    return obs.groupBy(*by).agg(F.sum("value").alias("sum"), F.count("value").alias("count"))


def counter(increments: DataFrame, *by: str) -> DataFrame:
    """Sums of increments; those that are not positive count nothing."""
    return increments.groupBy(*by).agg(F.sum(F.greatest("value", F.lit(0.0))).alias("value"))


def gauge(changes: DataFrame, *by: str) -> DataFrame:
    """The value that was set last, by seq."""
    return changes.groupBy(*by).agg(F.max_by("value", "seq").alias("value"))


def rebucketed(source: DataFrame, bounds: list[float]) -> DataFrame:
    """Counts of source buckets (low, high, n) in coarser ones by their upper edge, with the sum estimated from their middles."""
    edges = F.array(*map(F.lit, bounds))
    at = F.get(F.filter(edges, lambda b: b >= F.col("high")), F.lit(0))
    return source.groupBy(at.alias("le")).agg(F.sum("n").alias("n"), F.sum((F.col("low") + F.col("high")) / 2 * F.col("n")).alias("sum"))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def exposition(values: DataFrame) -> DataFrame:
    """One text for each family: its TYPE line and samples name{label="..."} value, by label. values: (name, kind, label, label_value, value)."""
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    line = F.concat(F.col("name"), F.lit("{"), F.col("label"), F.lit('="'), _escaped(F.col("label_value")), F.lit('"} '), number)
    lines = F.sort_array(F.collect_list(F.struct("label_value", line.alias("line"))))
    grouped = values.groupBy("name", "kind").agg(lines.alias("lines"))
    return grouped.select("name", F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.col("kind"), F.lit("\n"), F.array_join(F.transform("lines", lambda e: e["line"]), "\n")).alias("text"))


def status_class(code: Column) -> Column:
    return F.when(code.between(100, 599), F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))).otherwise("other")
