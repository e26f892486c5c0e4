"""Folds over the blocks of a file: candidates and their confirmation, simple merging, evaluation against labels.

These depend on order, so each fold states a total order of its input. They
run per file, or per ad of a file where other ads make no difference, whose
rows are as many as the file has blocks and detections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import folded

#: Milliseconds: alignments this close are the same; blocks this close follow one another; slack of coverage.
SAME_START, FOLLOWS, SLACK = 150, 250, 50
CONFIRM_SCORE = 40


def fold_candidates(rows: list[dict], confirm_score: int = CONFIRM_SCORE) -> list[dict]:
    """Candidates after all blocks of one file.

    rows: block_from, block_to, ad, start, end, score; in order of blocks. Rows
    with a null ad only tell that a block was covered. A detection agrees with
    the candidate that it overlaps if their starts are close and its block
    follows; otherwise the higher score stays. A candidate is confirmed, for
    good while its alignment stays, when the whole ad was covered, or two
    blocks agree on it with a sufficient score.
    """
    found: list[dict] = []
    covered: list[list[int]] = []
    blocks: dict[tuple[int, int], list[dict]] = {}
    for r in rows:
        blocks.setdefault((r["block_from"], r["block_to"]), []).append(r)
    for (low, high), dets in sorted(blocks.items()):
        if covered and low <= covered[-1][1] + SLACK:
            covered[-1][1] = max(covered[-1][1], high)
        else:
            covered.append([low, high])
        for d in dets:
            if d["ad"] is None:
                continue
            e = next((e for e in found if e["ad"] == d["ad"] and d["start"] < e["end"] and e["start"] < d["end"]), None)
            if e is None:
                found.append({k: d[k] for k in ("ad", "start", "end", "score")} | {"agree": 1, "last_to": high, "confirmed": False})
            elif abs(d["start"] - e["start"]) < SAME_START:
                e["agree"] += abs(low - e["last_to"]) < FOLLOWS
                e["last_to"], e["score"] = high, max(e["score"], d["score"])
            elif d["score"] > e["score"]:
                e.update({k: d[k] for k in ("start", "end", "score")} | {"agree": 1, "last_to": high, "confirmed": False})
        for e in found:
            whole = any(a <= e["start"] + SLACK and b >= e["end"] - SLACK for a, b in covered)
            e["confirmed"] = e["confirmed"] or whole or (e["agree"] >= 2 and e["score"] >= confirm_score)
    return found


def candidates(dets: DataFrame, confirm_score: int = CONFIRM_SCORE) -> DataFrame:
    """(file, ad, start, end, score, agree, confirmed) from (file, block_from, block_to, ad, start, end, score, ord)."""

    names = ["file", "block_from", "block_to", "ad", "start", "end", "score", "ord"]

    def fold(rows: list[tuple]) -> list[tuple]:
        found = fold_candidates([dict(zip(names, r, strict=True)) for r in rows], confirm_score)
        return [(rows[0][0], *(e[k] for k in ("ad", "start", "end", "score", "agree", "confirmed"))) for e in found]

    return folded(dets.select(*names), ["file"], ["block_from", "block_to", "ord"], fold, "file string, ad long, start long, end long, score long, agree long, confirmed boolean")


def merged(dets: DataFrame) -> DataFrame:
    """(file, ad, start_ms, end_ms, score): overlapping detections of an ad in order of ord are one; the higher score stays."""

    def fold(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in rows:
            at = next((i for i, e in enumerate(kept) if r[2] < e[3] and e[2] < r[3]), None)
            if at is None:
                kept.append(r[:5])
            elif r[4] > kept[at][4]:
                kept[at] = r[:5]
        return kept

    return folded(dets.select("file", "ad", "start_ms", "end_ms", "score", "ord"), ["file", "ad"], ["ord"], fold, "file string, ad long, start_ms long, end_ms long, score long")


def same_occurrence(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two intervals overlap by half of the shorter one."""
    return 2 * (F.least(e1, e2) - F.greatest(s1, s2)) >= F.least(e1 - s1, e2 - s2)


def assigned(truth: DataFrame, dets: DataFrame) -> DataFrame:
    """(file, label_id, det): each label in order of label_id with the best-scoring detection that is left, or null; of equal scores the first by ord.

    A label that no detection fits, and one that does, are both rows; detections
    that no label took are false.
    """
    both = truth.select("file", "ad", "start_ms", "end_ms", F.lit(None).cast("long").alias("score"), F.col("label_id").alias("n"), F.lit(0).alias("side"))
    both = both.unionByName(dets.select("file", "ad", "start_ms", "end_ms", "score", F.col("ord").alias("n"), F.lit(1).alias("side")))

    def fold(rows: list[tuple]) -> list[tuple]:
        left = [r for r in rows if r[6] == 1]
        out = []
        for file, _, start, end, _, n, side in rows:
            if side == 0:
                fits = [d for d in left if 2 * (min(end, d[3]) - max(start, d[2])) >= min(end - start, d[3] - d[2])]
                best = max(fits, key=lambda d: (d[4], -d[5]), default=None)
                if best is not None:
                    left.remove(best)
                out.append((file, n, None if best is None else best[5]))
        return out

    return folded(both, ["file", "ad"], ["side", "n"], fold, "file string, label_id long, det long")


def summary(assigned_: DataFrame, truth: DataFrame, dets: DataFrame) -> DataFrame:
    """One row: labels, found, unverified, recall, false detections, the weakest true score, start errors (whole milliseconds)."""
    d = dets.select("file", F.col("ord").alias("det"), F.col("start_ms").alias("d_start"), "score")
    hits = assigned_.join(truth.select("file", "label_id", "start_ms", "verified"), ["file", "label_id"]).join(d, ["file", "det"], "left")
    err = F.abs(F.col("d_start") - F.col("start_ms"))
    counts = hits.agg(
        F.count("*").alias("labels"),
        F.count("det").alias("found"),
        F.count_if(~F.col("verified")).alias("unverified"),
        F.min("score").alias("weakest"),
        F.floor(F.avg(err)).cast("long").alias("err_mean"),
        F.max(err).alias("err_max"),
        F.floor(F.median(err)).cast("long").alias("err_median"),
    )
    total = dets.agg(F.count("*").alias("dets"))
    # one row each
    return counts.join(F.broadcast(total)).select("*", (F.col("found") / F.col("labels")).alias("recall"), (F.col("dets") - F.col("found")).alias("false_dets")).drop("dets")
