"""Histogram sort into shards of near-equal bytes.

Every row gets a 48-digit key: the hash of its text, then of its id, then of
its position in the scan. Splitters between shards are found by counting exact
bytes below candidate boundaries: a first histogram over all key prefixes, then
finer ones only inside the cells that hold an unmet boundary, until every
splitter is within the tolerance. Only then do rows move, once.

Equal texts share a key prefix, so they stay in one shard unless their group is
larger than the tolerance allows; a hot group is split by id, and identical
rows by their position.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEY_DIGITS, FIRST, STEP = 48, 3, 2
#: Sorts after every key that starts with the prefix before it.
AFTER = "G"


def _digits(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def sort_key(text: Column, row_id: Column) -> Column:
    return F.concat(_digits(F.xxhash64(F.coalesce(text, F.lit("")))), _digits(F.xxhash64(row_id)), _digits(F.xxhash64(F.monotonically_increasing_id())))


def _cells(keys: DataFrame, digits: int, within: list[str]) -> list[tuple[str, int, int]]:
    """(prefix, bytes, rows) in key order. At most 4096 cells, or 256 for each prefix in within."""
    if within:
        keys = keys.where(F.substring("key", 1, len(within[0])).isin(within))
    found = keys.groupBy(F.substring("key", 1, digits).alias("cell")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return sorted((r.cell, int(r.b), r.n) for r in found.collect())


def splitters(keys: DataFrame, n_shards: int, tolerance: float) -> list[str]:
    """n_shards - 1 boundaries such that the bytes below the i-th differ from i/n_shards of all by at most tolerance of a shard.

    keys: (key, size). A single row larger than the tolerance, which nothing
    can split, goes to the nearer side.
    """
    cells = _cells(keys, FIRST, [])
    total = sum(b for _, b, _ in cells)
    allowed = tolerance * total / n_shards
    found: dict[int, str] = {}
    open_: dict[str, tuple[int, list[int]]] = {}

    def place(cells: list[tuple[str, int, int]], start: int, targets: list[int]) -> None:
        below = list(accumulate((b for _, b, _ in cells), initial=start))
        at = 0
        for i in targets:
            want = total * i / n_shards
            while at < len(cells) - 1 and below[at + 1] < want:
                at += 1
            prefix, _, rows = cells[at]
            low, high = abs(want - below[at]), abs(below[at + 1] - want)
            if min(low, high) <= allowed or rows == 1 or len(prefix) >= KEY_DIGITS:
                found[i] = prefix if low <= high else prefix + AFTER
            else:
                open_.setdefault(prefix, (below[at], []))[1].append(i)

    if cells:
        place(cells, 0, list(range(1, n_shards)))
    digits = FIRST
    while open_:
        digits = min(digits + STEP, KEY_DIGITS)
        todo, finer = dict(open_), _cells(keys, digits, list(open_))
        open_.clear()
        for prefix, (start, targets) in todo.items():
            place([c for c in finer if c[0].startswith(prefix)], start, targets)
    return [found[i] for i in sorted(found)]


def shard_documents(df: DataFrame, n_shards: int = 24, tolerance: float = 0.01, rows_per_cell: int = 20_000, text: str = "text", row_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of df (all by default) with size, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    size is the UTF-8 bytes of the text plus 8. A null text has no bytes, a
    null id is an id like any other, identical rows each get a slot of their
    own, and an empty table gives an empty table. Columns of df named size,
    shard or slot are replaced. Within a shard, slots follow cells of hashed
    keys, so ranking never gathers a whole shard in one task.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("size", "shard", "slot")]
    df = df.drop("size", "shard", "slot")
    key, sub, before = (common.free_name(df, n) for n in ("key", "sub", "before"))
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).cast("long")
    keyed = common.written(df.select(*keep, size.alias("size"), sort_key(F.col(text), F.col(row_id)).alias(key)), "shard-keys")
    bounds = splitters(keyed.select(F.col(key).alias("key"), "size"), n_shards, tolerance)
    cells = max(16, math.ceil(keyed.count() / n_shards / rows_per_cell))
    shard = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda s: s <= F.col(key))) if bounds else F.lit(0)
    rows = keyed.withColumn("shard", shard.cast("int")).withColumn(sub, F.pmod(F.xxhash64(key), F.lit(cells)).cast("int"))
    below = Window.partitionBy("shard").orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", sub).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(below), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("shard", sub).orderBy(key))
    # the join deals rows out by (shard, cell), which is what the ranking needs too: one exchange
    return rows.join(starts, ["shard", sub]).withColumn("slot", (F.col(before) + rank - 1).cast("long")).select(*keep, "size", "shard", "slot")


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; a null text counts as an empty one."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = shard_documents(docs, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_histogram_sort": op10_histogram_sort}
ORACLE: dict[str, str] = {}
