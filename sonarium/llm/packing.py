"""Optimal length buckets and token-budget batches.

The lengths of all documents form one global histogram. Dynamic programming
over it chooses the bucket boundaries that minimise total padding, each
document being padded to the boundary of its bucket. Inside a bucket, batches
hold as many documents as the token budget allows at the bucket's length.

The cost of a bucket is linear in its boundary, so a round of the program keeps
the lower hull of lines, one for each cut, and walks along it: the time is in
proportion to the number of lengths.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

N_BUCKETS, TOKEN_BUDGET = 16, 65_536
#: Lengths up to EXACT, a power of two, have a histogram cell each, so boundaries are optimal for documents up to it. Above it cells are
#: 1/STEPS of a power of two wide, and boundaries optimal among the longest lengths of cells, of which there are at most
#: EXACT + 48 * STEPS whatever the corpus. It is a parameter: what is counted comes to the driver.
EXACT, STEPS = 1 << 16, 1024


def cell_of(length: Column, exact: int = EXACT) -> Column:
    power = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))
    width = F.greatest(F.lit(1), F.pow(F.lit(2.0), power) / STEPS)
    return F.when(length <= exact, length).otherwise((exact + (power - int(math.log2(exact))) * STEPS + F.floor(length / width) - STEPS).cast("long"))


def boundaries(lengths: list[int], counts: list[int], totals: list[int], n_buckets: int) -> list[int]:
    """At most n_buckets of lengths (ascending; the last among them) that minimise the padding.

    Cell j holds counts[j] documents with totals[j] tokens, the longest of
    lengths[j]. best[j] after b rounds is the least padding of the cells before
    j in b buckets. All in whole numbers.
    """
    size = len(lengths)
    if not size:
        return []
    n, t = [0, *accumulate(counts)], [0, *accumulate(totals)]
    best: list[int | None] = [0] + [None] * size
    rounds = []
    for _ in range(min(n_buckets, size)):
        new: list[int | None] = [None] * (size + 1)
        cut = [0] * (size + 1)
        slopes: list[int] = []
        bases: list[int] = []
        cuts: list[int] = []
        at = 0
        for j in range(1, size + 1):
            if best[j - 1] is not None:  # a cut before cell j - 1: best + t - x * n at a boundary of x
                slope, base = -n[j - 1], best[j - 1] + t[j - 1]
                while len(slopes) > 1 and (base - bases[-2]) * (slopes[-2] - slopes[-1]) <= (bases[-1] - bases[-2]) * (slopes[-2] - slope):
                    del slopes[-1], bases[-1], cuts[-1]
                slopes.append(slope)
                bases.append(base)
                cuts.append(j - 1)
                at = min(at, len(slopes) - 1)
            if not slopes:
                continue
            x = lengths[j - 1]
            while at + 1 < len(slopes) and bases[at + 1] + slopes[at + 1] * x < bases[at] + slopes[at] * x:
                at += 1
            new[j], cut[j] = bases[at] + slopes[at] * x + x * n[j] - t[j], cuts[at]
        best = new
        rounds.append((new[size], cut))
    last = min((b for b in range(len(rounds)) if rounds[b][0] is not None), key=lambda b: rounds[b][0])
    found, j = [], size
    for b in range(last, -1, -1):
        found.append(int(lengths[j - 1]))
        j = rounds[b][1][j]
    return found[::-1]


def pack(df: DataFrame, length: Column, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, rows_per_cell: int = 20_000, row_id: str = "doc_id", keep: list[str] | None = None, exact: int = EXACT) -> DataFrame:
    """The columns keep of df (all by default) with n_tokens, bucket, bucket_tokens (its boundary), slot (gapless in the bucket), batch and place (in the batch).

    A batch of a bucket holds token_budget // bucket_tokens documents, one at
    least, so only a document longer than the budget exceeds it, alone. A null
    length counts as 0. Repeated rows each get a place; an empty table gives an
    empty table. Columns of df with the new names are replaced.
    """
    new = ["n_tokens", "bucket", "bucket_tokens", "slot", "batch", "place"]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    key, sub, before = (common.free_name(df, n) for n in ("key", "sub", "before"))
    # rows without an id are spread by their place, which is read from the table only
    own = F.when(F.col(row_id).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(row_id))
    rows = common.written(df.select(*keep, F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"), own.alias(key)), "pack-lengths")
    cells = sorted((r.top, r.n, r.total) for r in rows.groupBy(cell_of(F.col("n_tokens"), exact).alias("cell")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("total")).collect())
    tops = boundaries(*(list(x) for x in zip(*cells, strict=True)), n_buckets) if cells else [0]
    top = F.array(*(F.lit(x).cast("long") for x in tops))
    bucket = F.size(F.filter(top, lambda t: t < F.col("n_tokens")))
    parts = max(16, math.ceil(sum(c[1] for c in cells) / len(tops) / rows_per_cell))
    # documents of like length stand together, in hashed parts, so that no task ranks a whole bucket
    placed = rows.withColumn("bucket", bucket.cast("int")).withColumn(sub, F.pmod(F.col(key), F.lit(parts)).cast("int"))
    below = Window.partitionBy("bucket").orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("bucket", sub).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(below), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("bucket", sub).orderBy(key, "n_tokens"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_tokens")))).cast("long")
    out = placed.join(starts, ["bucket", sub]).withColumn("slot", (F.col(before) + rank - 1).cast("long")).withColumn("bucket_tokens", F.get(top, F.col("bucket")))
    return out.withColumn("batch", F.floor(F.col("slot") / fits).cast("long")).withColumn("place", (F.col("slot") % fits).cast("int")).select(*keep, *new)


def word_count(text: Column) -> Column:
    """Words of a text: places where a word starts."""
    return F.size(common.words_of(text)).cast("long")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its bucket and batch. A null text has no tokens; repeated rows each get a place; an empty table stays empty."""
    return pack(docs.select("doc_id", "lang", "source", "text"), word_count(F.col("text")), keep=["doc_id", "lang", "source"])


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, slot, batch, place) of every document; a null text has no tokens."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, word_count(F.col("text")), keep=["doc_id"])


QUERIES = {"op8_length_buckets": op8_length_buckets}
ORACLE: dict[str, str] = {}
