"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of shingles into classes of at
most 2^p. For each class in use, documents are covered by windows of 2^(p+1)
shingle positions at steps of 2^p, so any passage of an item's length lies
inside one window, and window and item are of like size: where the item is
contained, their Jaccard similarity is at least about 1/5, however long the
document. A window and an item that agree in any of 64 minhashes are
candidates (at similarity 1/5 one in a million is missed). Candidates are
verified exactly: the share of the item's distinct shingles that the whole
document holds.

Minima of a window come from minima of half-windows, so each hash of a shingle
is computed once for all size classes.

An item that repeats itself has far fewer shingles than positions, and may be
less like its window. Where it has fewer than half as many, a document is a
candidate if it holds any of the item's least shingles, of which so many are
listed that enough of the item cannot be there without one of them.

The benchmark is the stated query set: it is taken in blocks of at most
ITEMS_PER_BLOCK rows, whose index a task builds and a broadcast carries, and
each block meets all documents in one narrow pass.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

K, CONTAINMENT, HASHES, ITEMS_PER_BLOCK = 5, 0.8, 64, 50_000
_SLOTS = 1 << 16


@dataclass
class Index:
    """One block of items. levels: p to, for each hash, (sorted minima, their items, slots in use)."""

    k: int
    least: float
    sets: list[np.ndarray]
    levels: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    #: n to (sorted hashes, items) of items of fewer than k words, n being their number.
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    #: (sorted hashes, items): the listed shingles of items that repeat themselves.
    listed: tuple[np.ndarray, np.ndarray]


def build(texts: list[str | None], k: int = K, least: float = CONTAINMENT, hashes: int = HASHES) -> Index:
    sets: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    sizes = np.zeros(len(texts), np.int64)
    short: dict[int, list[tuple[int, int]]] = {}
    for row, words, before in shingles.batch_words(pa.array(texts, pa.string()), shingles.PUNCTUATION):
        for i in range(len(before) - 1):
            own = words[before[i] : before[i + 1]]
            if not len(own):
                continue
            h, _ = shingles.shingles(own, np.array([0, len(own)]), min(k, len(own)))
            sets[row + i] = np.unique(h)
            if len(own) < k:
                short.setdefault(len(own), []).append((int(h[0]), row + i))
            else:
                sizes[row + i] = len(h)
    level = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1))), -1).astype(int)
    levels = {}
    for p in sorted(set(level[level >= 0].tolist())):
        items = np.flatnonzero(level == p)
        bounds = np.concatenate(([0], np.cumsum([len(sets[i]) for i in items])))
        minima = shingles.minhashes(np.concatenate([sets[i] for i in items]), bounds, hashes)
        levels[p] = []
        for j in range(hashes):
            order = np.argsort(minima[:, j], kind="stable")
            slots = np.zeros(_SLOTS, bool)
            slots[minima[:, j] & np.uint64(_SLOTS - 1)] = True
            levels[p].append((minima[order, j], items[order], slots))
    listed = [(int(x), int(i)) for i in np.flatnonzero(sizes) if 2 * len(sets[i]) < sizes[i] for x in sets[i][: len(sets[i]) - math.ceil(least * len(sets[i]) - 1e-9) + 1]]
    by_hash = sorted(listed)
    tables = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)])) for n, x in short.items()}
    return Index(k, least, sets, levels, tables, (np.array([h for h, _ in by_hash], np.uint64), np.array([i for _, i in by_hash], np.int64)))


def _pairs(values: np.ndarray, owners: np.ndarray, table: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int]]:
    """(owner, item) wherever a value is in the sorted table."""
    low, high = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    for i in np.flatnonzero(high > low):
        for item in items[low[i] : high[i]].tolist():
            yield int(owners[i]), item


def search(column: pa.Array, index: Index) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) for every text of the column that holds enough of an item."""
    hashes = max((len(x) for x in index.levels.values()), default=0)
    for row, words, before in shingles.batch_words(column, shingles.PUNCTUATION):
        found: set[tuple[int, int]] = set()
        for n, (table, items) in index.short.items():
            h, bounds = shingles.shingles(words, before, n)
            counts = np.diff(before)
            h, owner = h[np.repeat(counts >= n, np.diff(bounds))], np.repeat(np.arange(len(counts)), np.diff(bounds))[np.repeat(counts >= n, np.diff(bounds))]
            yield from ((row + d, i, 1) for d, i in set(_pairs(h, owner, table, items)))
        if not index.levels or not len(words):
            continue
        h, bounds = shingles.shingles(words, before, index.k)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        position = np.arange(len(h)) - bounds[owner]
        # for each level the starts of its blocks among those of the level below, and their texts
        top, at = max(index.levels), []
        for p in range(min(index.levels), top + 1):
            starts = np.flatnonzero(position % (1 << p) == 0) if not at else np.flatnonzero(position % 2 == 0)
            owner, position = owner[starts], (position[starts] >> p if not at else position[starts] >> 1)
            at.append((p, starts, owner, np.append(owner[1:] == owner[:-1], False)))
        for j, (a, b) in enumerate(zip(*shingles.seeds(hashes), strict=True)):
            x = (h ^ a) * b
            x ^= x >> np.uint64(32)
            x *= np.uint64(shingles._MIX1)
            for p, starts, owner, same in at:
                x = np.minimum.reduceat(x, starts)
                if p in index.levels:
                    window = x.copy()
                    window[:-1][same[:-1]] = np.minimum(x[:-1], x[1:])[same[:-1]]
                    table, items, slots = index.levels[p][j]
                    hit = np.flatnonzero(slots[window & np.uint64(_SLOTS - 1)])
                    if len(hit):
                        found.update(_pairs(window[hit], owner[hit], table, items))
        if len(index.listed[0]):
            found.update(_pairs(h, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), *index.listed))
        own: dict[int, np.ndarray] = {}
        for d, i in sorted(found):
            if d not in own:
                own[d] = np.unique(h[bounds[d] : bounds[d + 1]])
            shared = len(np.intersect1d(own[d], index.sets[i], assume_unique=True))
            if shared >= index.least * len(index.sets[i]) - 1e-9:
                yield row + d, i, shared


def _built(k: int, least: float, hashes: int):
    """The texts of a block, all in one task, to one row with their index, pickled."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str | None] = []
        for batch in batches:
            texts += batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build(texts, k, least, hashes), 5)], pa.binary())], names=["index"])

    return make


def _blocks(bench: DataFrame, item_id: str, text: str, per_block: int, k: int, least: float, hashes: int) -> Iterator[tuple[DataFrame, Broadcast]]:
    """Blocks of at most about per_block items: a table (item, id) and the broadcast index of the texts by item. An empty benchmark has none."""
    spark = bench.sparkSession
    own = common.written(bench.select(F.col(item_id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("at")), "benchmark-items")
    n = own.count()
    blocks = -(-n // per_block)
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == b) if blocks > 1 else own
        # the items of one block, a stated bound, are numbered in one task
        numbered = common.written(part.coalesce(1).sortWithinPartitions("at").select("id", "text", F.monotonically_increasing_id().cast("int").alias("item")), "benchmark-block")
        made = numbered.coalesce(1).sortWithinPartitions("item").select("text").mapInArrow(_built(k, least, hashes), "index binary").collect()
        if made:
            yield numbered.select("item", "id"), spark.sparkContext.broadcast(bytes(made[0][0]))


def contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", k: int = K, least: float = CONTAINMENT, hashes: int = HASHES, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(row_id, item_id, n_shared, n_shingles, containment) for each row of docs and each item that it holds.

    Words are runs of ASCII letters and digits or of other characters than
    ASCII, A-Z in lower case. An item of fewer than k words is its whole
    sequence; one without words, and a text that is null or without words,
    match nothing. Repeated rows of docs or items each have rows.
    """
    kind = docs.select(row_id).schema[0].dataType.simpleString()
    item_kind = bench.select(item_id).schema[0].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"{row_id} {kind}, {item_id} {item_kind}, n_shared long, n_shingles long, containment double")
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    for names, carried in _blocks(bench, item_id, item_text, per_block, k, least, hashes):

        def find(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(carried.value)
            for batch in batches:
                hits = list(search(batch.column(1), index))
                at = pa.array([x[0] for x in hits], pa.int64())
                sizes = [len(index.sets[i]) for _, i, _ in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x[1] for x in hits], pa.int32()), pa.array([x[2] for x in hits], pa.int64()), pa.array(sizes, pa.int64())], names=["doc", "item", "n_shared", "n_shingles"])

        hits = rows.mapInArrow(find, f"doc {kind}, item int, n_shared long, n_shingles long")
        # names has at most a block of rows: a proven bound
        out = out.union(hits.join(F.broadcast(names), "item").select(F.col("doc").alias(row_id), F.col("id").alias(item_id), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")))
    return out


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, least: float = CONTAINMENT, hashes: int = HASHES, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; no row moves.

    Texts that are null or without words stay, repeated rows are judged alike,
    an empty table or benchmark changes nothing.
    """
    at = docs.columns.index(text)
    for _, carried in _blocks(bench, item_id, item_text, per_block, k, least, hashes):

        def keep(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(carried.value)
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[x[0] for x in search(batch.column(at), index)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; see clean for nulls, repeated rows and empty tables."""
    return clean(docs, common.table(spark, sf_dir, "benchmark"))


def op7_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for each document and each benchmark item that it holds."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_containment_search": op7_containment_search}
ORACLE: dict[str, str] = {}
