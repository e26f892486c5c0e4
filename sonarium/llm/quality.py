"""Weak supervision of quality rules.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or
abstains (0). Vote patterns are counted over the whole corpus; with eight rules
there are at most 3^8 of them, so expectation-maximisation over the patterns is
exact for every corpus size and runs in one row of one small table. It
estimates the accuracy of each rule and the share of good texts, from which
each pattern gets its posterior probability of quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is it that was for on are with as be this have from or by not but at an
der die das und ist von zu den mit sich auf für ein eine nicht dem des im
le la les et des est une un que qui dans pour pas sur de du avec elle
el los las y en por con una para es del se lo como más no
""".split()

MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5
ITERATIONS, THRESHOLD = 30, 0.5
#: The chance that a rule which votes calls a text good, for good texts and for bad ones, at the start: most bad texts
#: break only some rules. STRENGTH votes stand behind the start values; estimates stay within LOWEST and HIGHEST.
START_GOOD, START_BAD, START_PRIOR, STRENGTH, LOWEST, HIGHEST = 0.95, 0.5, 0.8, 5.0, 0.005, 0.995

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words", "n_sentence_ends"]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are told apart by 64-bit hashes of their words.
    """
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def repeated(ordered: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(ordered, i)["h"] == e["h"], F.lit(False))
        twice = F.filter(ordered, lambda e, i: same(e, i - 1) | same(e, i + 1))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda e, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - e, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, repeated))

    return let(windows, counted)


def features(text: Column) -> Column:
    """A struct of the FEATURES of a text, all bigint; null counts as an empty text."""
    body = F.coalesce(text, F.lit(""))
    bare = lambda x: F.length(F.translate(x, common.SPACES, ""))

    def counts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: bare(x) > 0)
        by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        by_word = let(
            common.words_of(t),
            lambda w: F.struct(
                F.size(w).alias("n"),
                _repeat_words(w).alias("repeat"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("stop"),
                F.size(F.filter(w, lambda x: F.upper(x) != F.lower(x))).alias("letter"),
            ),
        )
        return let(
            F.struct(by_word.alias("w"), by_line.alias("l")),
            lambda s: F.struct(
                *(
                    v.cast("long").alias(k)
                    for k, v in zip(
                        FEATURES,
                        [
                            s["w"]["n"],
                            bare(t),
                            F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
                            s["l"]["dup"],
                            s["w"]["repeat"],
                            s["l"]["n"],
                            s["w"]["stop"],
                            s["w"]["letter"],
                            F.length(t) - F.length(F.translate(t, ".!?", "")),
                        ],
                        strict=True,
                    )
                )
            ),
        )

    return let(body, counts)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def votes(f: dict[str, Column]) -> list[Column]:
    """The votes of the eight rules, from the counts by name."""
    share = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    n = f["n_words"]
    length, symbols, dup, repeat = share(f["word_chars"], n), share(f["n_symbols"], n), share(f["n_dup_lines"], f["n_lines"]), share(f["n_repeat_words"], n)
    stop, letters, ends = share(f["n_stop_words"], n), share(f["n_letter_words"], n), share(f["n_sentence_ends"], n)
    return [
        _vote(n >= 80, n < MIN_WORDS),
        _vote((length >= 3) & (length <= 11), (length < 2) | (length > 16)),
        _vote(symbols <= 0.02, symbols > 0.15),
        _vote(dup <= 0.05, dup > 0.3),
        _vote(repeat <= 0.1, repeat > 0.3),
        _vote(stop >= 0.08, stop < 0.02),
        _vote(letters >= 0.9, letters < 0.7),
        _vote(ends >= 0.02, ends < 0.005),
    ]


def posteriors(patterns: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(votes, posterior) for each row of patterns (votes array<int>, n), of which there are at most 3^rules.

    A pattern in which all rules abstain gets the share of good texts.
    """
    rows = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    rules = F.size(F.get("rows", F.lit(0))["votes"])

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    inside = lambda x: F.least(F.greatest(x, F.lit(LOWEST)), F.lit(HIGHEST))

    def posterior(v: Column, s: Column) -> Column:
        each = F.transform(v, lambda x, j: F.when(x > 0, F.log(F.get(s["good"], j) / F.get(s["bad"], j))).when(x < 0, F.log((1 - F.get(s["good"], j)) / (1 - F.get(s["bad"], j)))).otherwise(0.0))
        return 1 / (1 + F.exp(-(F.log(s["prior"] / (1 - s["prior"])) + total(each))))

    def improved(s: Column) -> Column:
        def estimate(e: Column) -> Column:
            def chance(weight, start: float):
                def of(j: Column) -> Column:
                    said = total(F.transform(e, lambda x: x["n"] * weight(x) * (F.get(x["v"], j) > 0).cast("double")))
                    cast_ = total(F.transform(e, lambda x: x["n"] * weight(x) * F.abs(F.get(x["v"], j))))
                    return inside((said + start * STRENGTH) / (cast_ + STRENGTH))

                return of

            good, bad = chance(lambda x: x["p"], START_GOOD), chance(lambda x: 1 - x["p"], START_BAD)
            share = total(F.transform(e, lambda x: x["n"] * x["p"])) / total(F.transform(e, lambda x: x["n"]))
            each = F.sequence(F.lit(0), F.size(s["good"]) - 1)
            # a rule is never taken to be worse than chance
            return let(
                F.struct(F.transform(each, good).alias("good"), F.transform(each, bad).alias("bad")),
                lambda r: F.struct(inside(share).alias("prior"), F.zip_with(r["good"], r["bad"], lambda g, b: F.greatest(g, b)).alias("good"), r["bad"].alias("bad")),
            )

        return let(F.transform("rows", lambda r: F.struct(r["votes"].alias("v"), r["n"].alias("n"), posterior(r["votes"], s).alias("p"))), estimate)

    flat = lambda x: F.transform(F.sequence(F.lit(1), rules), lambda _: F.lit(x))
    start = F.struct(F.lit(START_PRIOR).alias("prior"), flat(START_GOOD).alias("good"), flat(START_BAD).alias("bad"))
    fitted = rows.where(F.size("rows") > 0).select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, lambda s, _: improved(s)).alias("fit"))
    return fitted.select(F.explode(F.transform("rows", lambda r: F.struct(r["votes"].alias("votes"), posterior(r["votes"], F.col("fit")).alias("posterior")))).alias("r"), "fit").select("r.votes", "r.posterior", "fit")


NEW = ("features", "votes", "base_failed", "posterior", "kept")


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, iterations: int = ITERATIONS, into: tuple[str, ...] = NEW) -> DataFrame:
    """The columns keep of df (all by default) with five new ones, named by into: the struct features, votes array<int>, base_failed, posterior and kept.

    A null or empty text has no words and fails the base test. Equal rows are
    judged alike; an empty table gives an empty table. Columns of df with the
    names of the new ones are replaced; choose other names to keep them.
    """
    counts, cast_, base_failed, posterior, kept = into
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in into}]
    counted = df.select(*keep, features(F.col(text)).alias(counts))
    f = {k: F.col(counts)[k] for k in FEATURES}
    judged = common.written(counted.withColumn(cast_, F.array(*votes(f))), "quality")
    fitted = posteriors(judged.groupBy(F.col(cast_).alias("votes")).agg(F.count("*").alias("n")), iterations)
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > int(100 * MAX_REPEAT_SHARE) * f["n_words"])
    # at most 3^8 patterns: a proven bound
    return (
        judged.join(F.broadcast(fitted.select(F.col("votes").alias(cast_), F.col("posterior").alias(posterior))), cast_)
        .withColumn(base_failed, failed)
        .withColumn(kept, ~failed & (F.col(posterior) >= threshold))
        .select(*keep, *into)
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. Null and empty texts go, repeated rows are judged alike, an empty table stays empty; columns of any name pass."""
    into = tuple(common.free_name(docs, n) for n in NEW)
    return judge(docs, into=into).where(F.col(into[-1])).select(*docs.columns)


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, posterior) of every document; a null text counts as an empty one."""
    out = judge(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", *(F.col("features")[k].alias(k) for k in FEATURES[:5]), "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


QUERIES = {"op3_weak_supervision": op3_weak_supervision}
ORACLE: dict[str, str] = {}
