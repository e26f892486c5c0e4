"""Near-duplicates by MinHash with tensored banding.

A table key of plain banding needs minhashes of its own. Here two collections
of SIDE half-keys, of ROWS minhashes each, are paired into SIDE x SIDE table
keys: 2 SIDE ROWS minhashes do the work of SIDE^2 2 ROWS. With 8 and 2, texts
of similarity 0.8 share no key with a chance of 6 in 10000, of 0.85 with 7 in
100000 (both halves must miss).

1. Texts with the same shingle set form a class; from here on only classes count.
2. A half-key that no other class has cannot complete a shared table key, so
   only classes with shared half-keys on both sides make table keys at all.
3. In every table bucket, the class that shares most half-keys with others is
   the centre. Each class is first compared with its best centre only; links
   are confirmed on the full shingle sets. Their components settle most buckets.
4. In buckets that still hold several components, all pairs of classes of
   different components are compared, if their sizes allow a link. Buckets of
   at most SMALL classes give their pairs as rows, each pair once. The classes
   of larger ones are dealt out by the first half of the key only, of which
   there are SIDE and not SIDE^2, and compared in blocks of BLOCK x BLOCK
   within tasks, each pair where its first equal half is. Nothing is dropped or
   capped; a block task returns at most a spanning forest of the links it finds.

Shingle sets are made again, only for classes in buckets, when links are
confirmed: a filter, of at most MOST_BITS bits whatever the input, tells which
rows these could be. Nothing depends on how the source is split: rows are known
by hashes of id and text, and numbers of classes are read from the table that
holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

SIDE, ROWS, PERCENT, SMALL, BLOCK, LEAST_BITS, MOST_BITS = 8, 2, 80, 16, 256, 1 << 23, 1 << 27
#: Pairs of a block up to which sets are compared one by one; more are counted as a product of matrices, so many columns at a time.
FEW, COLUMNS = 512, 8192
_BITMAP = 1 << 15


def _prints(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A fingerprint of each set: two sums over its hashes, and its size."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    both = np.zeros((len(sizes), 2), np.uint64)
    if len(full):
        both[full, 0] = np.add.reduceat(shingles.mix(sets), bounds[full])
        both[full, 1] = np.add.reduceat(shingles.mix(sets ^ np.uint64(shingles._STEP)), bounds[full])
    return [bytes(x) for x in np.concatenate((both, sizes[:, None].astype(np.uint64)), axis=1)]


def _signatures(k: int, side: int, rows: int):
    """Arrow batches (row, id, text) to (row, id, n, fp, halves); the halves of an empty set are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, halves = [], [], []
            for _, words, before in shingles.batch_words(batch.column(2)):
                sets, bounds = shingles.distinct(*shingles.shingles(words, before, k))
                minima = shingles.minhashes(sets, bounds, 2 * side * rows).reshape(len(bounds) - 1, 2 * side, rows)
                keys = minima[:, :, 0].copy()
                for j in range(1, rows):
                    keys = shingles.mix(keys * np.uint64(shingles._MIX2) ^ minima[:, :, j])
                sizes = np.diff(bounds)
                n += sizes.tolist()
                prints += _prints(sets, bounds)
                halves += [x if s else None for x, s in zip(keys.view(np.int64).tolist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], names=["row", "id", "n", "fp", "halves"])

    return sign


def _sets(k: int, bits):
    """Arrow batches (row, text) to (row, fp, set) for the rows that the filter has; a set is its sorted 64-bit hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little")
        for batch in batches:
            on = np.flatnonzero(wanted[np.asarray(batch.column(0)) & (len(wanted) - 1)])
            for at in range(0, len(on), 256):
                some = batch.take(pa.array(on[at : at + 256]))
                out, prints = [], []
                for _, words, before in shingles.batch_words(some.column(1)):
                    sets, bounds = shingles.distinct(*shingles.shingles(words, before, k))
                    out += [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    prints += _prints(sets, bounds)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(prints, pa.binary()), pa.array(out, pa.binary())], names=["row", "fp", "set"])

    return make


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a and b| >= percent |a or b|, for sorted arrays of distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a)) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist(), strict=True)
            good = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in pairs]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each left set has in common with each right one."""
    n, m = [len(x) for x in left], [len(x) for x in right]
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)))
    is_left = np.arange(len(at)) < sum(n)
    sides = np.zeros((2, len(values)), bool)
    sides[0, at[is_left]] = True
    sides[1, at[~is_left]] = True
    new = np.where(sides.all(axis=0), np.cumsum(sides.all(axis=0)) - 1, -1)
    col = new[at]
    out = np.zeros((len(n), len(m)), np.float32)
    for low in range(0, int(new.max()) + 1 if len(new) else 0, COLUMNS):
        here = (col >= low) & (col < low + COLUMNS)
        a, b = np.zeros((len(n), COLUMNS), np.float32), np.zeros((len(m), COLUMNS), np.float32)
        a[row[here & is_left], col[here & is_left] - low] = 1
        b[row[here & ~is_left], col[here & ~is_left] - low] = 1
        out += a @ b.T
    return out.astype(np.int64)


def _compare_blocks(percent: int, side: int):
    """A group is one pair of blocks of the classes with one half-key: rows (i, node, component, halves, set, left): compare left with right rows."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        parts = [group[group["left"]], group[~group["left"]]]
        halves = [np.stack(p["halves"].to_list()) if len(p) else np.empty((0, 2 * side), np.int64) for p in parts]
        nodes, of = ([p[c].to_numpy(np.int64) for p in parts] for c in ("node", "component"))
        sets = [[np.frombuffer(x, np.uint64) for x in p["set"]] for p in parts]
        size = [np.array([len(x) for x in y], np.int64) for y in sets]
        same = halves[0][:, None, :] == halves[1][None, :, :]
        a, b = same[:, :, :side], same[:, :, side:]
        first = a.argmax(axis=2)
        least, most = np.minimum(size[0][:, None], size[1][None, :]), np.maximum(size[0][:, None], size[1][None, :])
        asked = a.any(axis=2) & b.any(axis=2) & (first == int(group["i"].iloc[0])) & (of[0][:, None] != of[1][None, :]) & (100 * least >= percent * most)
        found = []
        if int(asked.sum()) > FEW:
            rows, cols = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
            both = _common([sets[0][i] for i in rows], [sets[1][i] for i in cols])
            union = size[0][rows][:, None] + size[1][cols][None, :] - both
            good = asked[np.ix_(rows, cols)] & (both > 0) & (100 * both >= percent * union)
            pairs = [(rows[i], cols[j]) for i, j in np.argwhere(good)]
        else:
            pairs = [(i, j) for i, j in np.argwhere(asked) if linked(sets[0][i], sets[1][j], percent)]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in pairs:
            x, y = root(int(of[0][i])), root(int(of[1][j]))
            if x != y:
                parent[x] = y
                found.append((int(nodes[0][i]), int(nodes[1][j])))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return compare


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("v"), F.col("set").alias("set_v"))
    right = sets.select(F.col("node").alias("u"), F.col("set").alias("set_u"))
    return pairs.join(left, "v").join(right, "u").select("u", "v", "set_u", "set_v")


def _bits_of(rows: DataFrame, n: int):
    """A broadcast filter with a bit on for each of the n row hashes: at most MOST_BITS / 32768 rows come to the driver, whatever the input."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    bit = F.col("row").bitwiseAND(F.lit(bits - 1))
    maps = rows.groupBy(F.shiftright(bit, 15).alias("at")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(_BITMAP - 1))).alias("map"))
    out = bytearray(bits // 8)
    for r in maps.toLocalIterator():
        out[r.at * _BITMAP // 8 : (r.at + 1) * _BITMAP // 8] = r.map
    return rows.sparkSession.sparkContext.broadcast(bytes(out))


def row_hash(row_id: Column, text: Column) -> Column:
    """What a row is known by, besides its id, however the source is split."""
    return F.xxhash64(row_id.cast("long"), text)


def near_duplicates(df: DataFrame, k: int, percent: int = PERCENT, side: int = SIDE, rows: int = ROWS, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row, id, n_shingles, component_id, kept) for each row of df.

    row is the row_hash of the row. component_id is the least id that can be
    reached over links (of those that are not null); kept marks one row of each
    component, one with this id (of several such rows, the one with the least
    row hash, and of rows equal in id and text any one). Words are runs without
    ASCII white space, A-Z in lower case; a text of fewer than k words has its
    whole sequence as one shingle. Null and empty texts have no shingles and are
    components of their own, also where they share an id. A row with a null id
    that reaches no other id has the component null and is kept. An empty table
    gives an empty table; other columns of df are not read.
    """
    read = df.select(row_hash(F.col(row_id), F.col(text)).alias("row"), F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = common.written(read.mapInArrow(_signatures(k, side, rows), "row long, id long, n long, fp binary, halves array<long>"), "signatures")
    # classes; an empty set is in none. Their numbers are read from the table only
    classes = signed.where("n > 0").groupBy("fp").agg(F.min(F.struct("row", "halves")).alias("x"), F.min("id").alias("least"), F.first("n").alias("n"))
    classes = common.written(classes.select("fp", F.col("x.row").alias("row"), "least", "n", F.col("x.halves").alias("halves"), F.monotonically_increasing_id().alias("node")), "classes")
    half = classes.select("node", F.col("n").alias("size"), F.posexplode("halves").alias("i", "h"))
    shared = half.groupBy("i", "h").agg(F.count("*").alias("n")).where("n > 1")
    sides = half.join(shared, ["i", "h"]).groupBy("node", "size").agg(F.sum("n").alias("weight"), F.collect_list(F.struct("i", "h")).alias("halves"))
    a, b = F.filter("halves", lambda x: x["i"] < side), F.filter("halves", lambda x: x["i"] >= side)
    paired = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct((x["i"] * side + y["i"] - side).alias("table"), F.xxhash64(x["i"], x["h"], y["i"], y["h"]).alias("key")))))
    keys = common.written(sides.select("node", "size", "weight", F.explode(paired).alias("made")).select("node", "size", "weight", "made.*"), "table-keys")
    centre = F.max(F.struct("weight", (-F.col("node")).alias("least"))).alias("centre")
    full = keys.groupBy("table", "key").agg(F.count("*").alias("n"), centre).where("n > 1")
    buckets = common.written(keys.join(full, ["table", "key"]).select("table", "key", "node", "size", "centre"), "buckets")
    common.dropped(keys)
    best = buckets.groupBy("node").agg(F.max("centre").alias("centre")).select(F.col("node").alias("u"), (-F.col("centre.least")).alias("v"))
    best = common.written(best, "best-centres")
    wanted = common.written(classes.select("node", "fp", "row").join(best.select(F.col("u").alias("node")), "node", "left_semi"), "wanted-sets")
    n_wanted = wanted.count()
    bits = _bits_of(wanted, n_wanted)
    again = read.select("row", "text").mapInArrow(_sets(k, bits), "row long, fp binary, set binary")
    sets = common.written(again.join(F.broadcast(wanted) if n_wanted <= common.FEW_KEYS else wanted, ["row", "fp"]).select("node", "set"), "shingle-sets")
    bits.destroy()
    if sets.count() > n_wanted:  # rows equal in id and text make the same set
        sets = common.written(sets.groupBy("node").agg(F.first("set").alias("set")), "shingle-sets")
    links = common.written(_with_sets(best.where("u <> v"), sets).mapInArrow(_confirm(percent), "u long, v long"), "centre-links")
    grouped = components(links)
    # what the centres leave open
    joined = buckets.select("table", "key", "node", "size").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = common.written(joined, "bucket-components")
    common.dropped(buckets)
    by_part = joined.groupBy("table", "key", "component").agg(F.count("*").alias("n"))
    parted = by_part.groupBy("table", "key").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    open_ = joined.join(parted, ["table", "key"])
    small = open_.where(F.col("n") <= SMALL).select("table", "key", "node", "component", "size")
    other = small.select("table", "key", F.col("node").alias("v"), F.col("component").alias("of"), F.col("size").alias("size_v"))
    fits = 100 * F.least("size", "size_v") >= percent * F.greatest("size", "size_v")
    pairs = small.withColumnRenamed("node", "u").join(other, ["table", "key"]).where((F.col("u") < F.col("v")) & (F.col("component") != F.col("of")) & fits).select("u", "v").distinct()
    pairs = pairs.join(best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    more = _with_sets(common.written(pairs, "bucket-pairs"), sets).mapInArrow(_confirm(percent), "u long, v long")
    # a pair that shares a large bucket shares the first half of its key; its first equal half is that of a bucket, small or large, too
    halves = open_.where(F.col("n") > SMALL).select(F.floor(F.col("table") / side).cast("int").alias("i"), "node", "component").distinct()
    halves = common.written(halves.join(classes.select("node", "halves"), "node").select("i", F.get("halves", F.col("i")).alias("h"), "node", "component"), "open-halves")
    if not halves.isEmpty():
        counts = halves.groupBy("i", "h", "component").agg(F.count("*").alias("n")).groupBy("i", "h").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("big")).where("parts > 1")
        counts = counts.select("i", "h", F.col("big.component").alias("big"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all"), F.ceil((F.col("n") - F.col("big.n")) / BLOCK).cast("int").alias("rest"))
        halves = halves.join(counts, ["i", "h"])
        block = lambda n, *salt: F.pmod(F.xxhash64("node", *map(F.lit, salt)), F.col(n)).cast("int")
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        left = halves.where("component <> big").select("i", "h", "node", "component", block("rest", 1).alias("p"), F.explode(upto("all")).alias("q"), F.lit(True).alias("left"))
        right = halves.select("i", "h", "node", "component", F.explode(upto("rest")).alias("p"), block("all", 2).alias("q"), F.lit(False).alias("left"))
        dealt = left.unionByName(right).join(sets.join(classes.select("node", "halves"), "node"), "node")
        blocks = dealt.groupBy("i", "h", "p", "q").applyInPandas(_compare_blocks(percent, side), "u long, v long")
        more = more.unionByName(blocks)
    more = common.written(more, "bucket-links")
    common.dropped(sets, joined)
    if not more.isEmpty():
        grouped = components(grouped.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    # class -> component -> least id of the component; a class without links is its own
    linked_ = grouped.join(classes.select("node", "fp", "least"), "node")
    names = common.written(linked_.groupBy("component").agg(F.min("least").alias("component_id")), "component-names")
    named = linked_.join(common.few(names), "component").select("fp", "component_id", "component")
    alone = classes.join(grouped.select("node"), "node", "left_anti").select("fp", F.col("least").alias("component_id"), F.col("node").alias("component"))
    numbered = signed.select("row", "id", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp"))
    out = common.written(numbered.join(named.unionByName(alone), "fp", "left").select("row", "id", "n", "component", "component_id", F.monotonically_increasing_id().alias("at")), "components")
    common.dropped(signed, classes)
    # of several rows with the least id, one stays
    first = out.where("component IS NOT NULL AND id <=> component_id").groupBy("component").agg(F.min(F.struct("row", "at")).alias("x")).select(F.col("x.at").alias("at"), F.lit(True).alias("stays"))
    out = out.join(first, "at", "left")
    return out.select("row", "id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("component").isNull() | F.col("stays").isNotNull()).alias("kept"))


def one_of_each(df: DataFrame, k: int = 5, percent: int = PERCENT, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of df that near_duplicates keeps, with its columns. Rows without words stay, repeated or not; of rows equal in id and text, but with other columns that differ, any one stays."""
    found = near_duplicates(df, k, percent, text=text, row_id=row_id)
    of_key = found.groupBy("row", "id").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept")).where("n_kept < n")
    of_key = common.written(of_key.select("row", "id", (F.col("n_kept") == 0).alias("goes")), "near-duplicates")
    row, own, goes = (common.free_name(df, n) for n in ("row", "own", "goes"))
    keyed = df.withColumn(row, row_hash(F.col(row_id), F.col(text))).withColumn(own, F.col(row_id).cast("long"))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("row").alias(row), F.col("id").alias(goes))
        return rows.join(common.few(k), (keyed[row] == k[row]) & keyed[own].eqNullSafe(k[goes]), how)

    stays = among(keyed, of_key, "left_anti").select(*df.columns)
    equal = of_key.where("NOT goes")
    if equal.isEmpty():
        return stays
    return stays.unionByName(among(keyed, equal, "left_semi").dropDuplicates([row, own]).select(*df.columns))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8. For nulls, ties, repeated rows and empty tables see near_duplicates and one_of_each; columns of any name pass."""
    return one_of_each(docs, 5)


def op6_tensored_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; texts without words are components of their own, with kept true."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"), 2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES = {"op6_tensored_banding": op6_tensored_banding}
ORACLE: dict[str, str] = {}
