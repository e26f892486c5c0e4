"""Personal data: patterns, and information-theoretic sanitisation of what gives them away.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers;
each value is a protected entity. The terms (runs of letters and digits) of a
text with a mention, but for the protected values, are its context. Over the
whole corpus, the pointwise mutual information of an entity c and a term t, as a share of the information content
of c, says how far t discloses c (Sanchez and Batet's C-sanitization):

    disclosure(c, t) = log2(p(c, t) / (p(c) p(t))) / -log2 p(c) = 1 - log2(p(c | t)) / log2(p(c))

with p(c, t) the share of documents where t stands with c, p(c) that
where c is, p(t) that where t is anywhere. It is 1 where t occurs with c only.
Terms above GENERALISE are generalised: of the term only its shape stays, which
is number, code (letters and digits), name (starts with a capital) or word.
Terms above REMOVE go.

Few texts say little: in place of the ratio n(c, t) / n(t) for p(c | t) stands
the lower end of its Wilson interval, of width DEVIATIONS, in which copies of a
text count once. So an entity of one text has disclosing terms as well, which
are the words that occur nowhere else, provided that the corpus is large.

A told term is replaced wherever it stands in a text with its entity. In texts
without the entity it is replaced only where it is above REMOVE and at least
SPREAD distinct texts tell it: such a term hardly stands without the entity. A
weaker one is an ordinary word of other people's texts, which stay as they are.

All of it is DataFrame functions. Patterns that could scan a long run again and
again are anchored to where a match can start, with the same matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

GENERALISE, REMOVE, DEVIATIONS, SPREAD = 0.8, 0.95, 1.96, 2
CHUNK = 128

#: In the order in which spans of equal start are listed. Possessive quantifiers keep the matcher from recursion and retries;
#: a match starts where the one before ended, or where its first run starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "number": "[NUMBER]", "code": "[CODE]", "name": "[NAME]", "word": "[WORD]", "remove": ""}
#: The kinds of spans of disclosing terms.
TERM_KINDS = ["number", "code", "name", "word", "remove"]
TERM = r"[\p{L}\p{N}]++"

_SPAN = "array<struct<start:int,kind:string,end:int,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _value(kind: str, m: Column) -> Column:
    return F.lower(m) if kind == "email" else m if kind == "ip" else _digits(m)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def _before(lengths: Column) -> Column:
    """For each of an array of lengths the sum of those before it, by chunks, so that a long array costs no quadratic time."""
    n = F.size(lengths)
    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: _sum(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))
    bases = let(sums, lambda s: F.transform(s, lambda _, c: _sum(F.slice(s, F.lit(1), c))))

    def each(base: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            c = F.floor(i / CHUNK).cast("int")
            return F.get(base, c) + _sum(F.slice(lengths, c * CHUNK + 1, i - c * CHUNK))

        return F.transform(lengths, at)

    return let(bases, each)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, m>> of the leftmost non-overlapping matches; start counts code points."""
    kind = "array<struct<start:int,m:string>>"

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
            before = let(lengths, _before)
            return let(before, lambda b: F.transform(found, lambda m, i: F.struct((F.get(b, i) + F.length(F.get(gaps, i))).alias("start"), m.alias("m"))))

        return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), with_gaps).cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """The valid matches of all patterns: array<struct<start, kind, end, value>>, by start, then in the order of KINDS."""

    def of(kind: str, t: Column) -> Column:
        hint = {"email": F.instr(t, "@") > 0, "phone": F.instr(t, "+") > 0}.get(kind)
        found = F.transform(F.filter(matches(t, PATTERNS[kind]), lambda x: _valid(kind, x["m"])), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).cast("int").alias("end"), _value(kind, x["m"]).alias("value"))).cast(_SPAN)
        return found if hint is None else F.when(hint, found).otherwise(F.array().cast(_SPAN))

    # the kinds stand in alphabetical order but for email, which is why they are ranked
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    ranked = lambda spans: F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s.alias("s")))), lambda r: r["s"])
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.concat(*(of(k, t) for k in KINDS)), lambda s: F.when(F.size(s) > 1, ranked(s)).otherwise(s)))


def _blanked(text: Column, spans: Column) -> Column:
    """text with spaces in place of the spans (by start)."""

    def step(a: Column, s: Column) -> Column:
        kept = F.substr(text, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
        blank = F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(a["at"], s["start"])))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.array_append(a["out"], F.concat(kept, blank)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text)))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _least_share(part: Column, whole: Column, texts: Column, deviations: float) -> Column:
    """The lower end of the Wilson interval of part / whole; of the part's documents so many texts are distinct."""
    p, z2 = part / whole, deviations**2
    n = whole * texts / part
    return (p + z2 / (2 * n) - deviations * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n) + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing(df: DataFrame, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, deviations: float = DEVIATIONS, spread: int = SPREAD) -> DataFrame:
    """(key, told map<term, kind>), a written table, for each distinct text with disclosing terms; kind is generalise or remove.

    Null and empty texts have no terms; copies of a text have one row; a corpus
    without mentions, or an empty one, gives an empty table.
    """
    spark = df.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    total = df.select(F.lit(1)).count()
    found = df.select(t.alias("text")).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    found = found.select(_text_key(F.col("text")).alias("key"), F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), s["value"]))).alias("entities"), _terms(_blanked(F.col("text"), F.col("spans"))).alias("terms"))
    # the mentions are a small part of the corpus; their table holds no texts
    mentions = common.written(found.groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "mentions")
    term_docs = df.select(F.explode(_terms(t)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    named = mentions.select("key", "copies", F.explode("entities").alias("entity"))
    named = named.join(named.groupBy("entity").agg(F.sum("copies").alias("n_c")), "entity").where(F.col("n_c") < total)
    # a term of more documents than this cannot reach the score, so pairs are made of rare terms only
    most = lambda n: n / F.pow(n / F.lit(float(max(total, 1))), 1 - generalise) + 1
    entities = named.groupBy("key", "copies").agg(F.collect_list(F.struct("entity", "n_c")).alias("entities"), F.max("n_c").alias("top"))
    rare = mentions.select("key", F.explode("terms").alias("term")).join(term_docs, "term", "left").join(entities, "key").where(F.coalesce("n_t", F.lit(0)) <= most(F.col("top")))
    pairs = rare.select("term", "n_t", "copies", F.explode("entities").alias("e")).select("term", "n_t", "copies", "e.*")
    joint = pairs.groupBy("entity", "term", "n_c").agg(F.sum("copies").alias("n_ct"), F.count("*").alias("texts"), F.max("n_t").alias("n_t"))
    share = 1 - F.log2(_least_share(F.col("n_ct"), F.greatest("n_t", "n_ct"), F.col("texts"), deviations)) / F.log2(F.col("n_c") / F.lit(float(max(total, 1))))
    scored = joint.withColumn("disclosure", share).where(F.col("disclosure") >= generalise)
    told = common.written(scored.select("entity", "term", "texts", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("kind")), "disclosing-terms")
    within = named.join(told, "entity").select("key", "term", "kind")
    within = within.join(mentions.select("key", F.explode("terms").alias("term")), ["key", "term"])
    everywhere = common.written(told.where((F.col("texts") >= spread) & (F.col("kind") == "remove")).select("term", "kind", F.xxhash64("term").alias("hash")).distinct(), "terms-everywhere")
    n = everywhere.count()
    if n:
        words = df.select(F.explode(let(_text_key(F.col(text)), lambda k: F.transform(_terms(t), lambda w: F.struct(k.alias("key"), w.alias("term"))))).alias("x")).select("x.*")
        if n <= common.FEW_KEYS:  # so nearly all words of the corpus stay out of the join below
            words = words.join(F.broadcast(everywhere.select(F.col("hash").alias("h"))), F.xxhash64("term") == F.col("h"), "left_semi")
        within = within.unionByName(words.join(everywhere.drop("hash"), "term").select("key", "term", "kind"))
    each = within.groupBy("key", "term").agg(F.max("kind").alias("kind"))
    out = common.written(each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("told")), "told-terms")
    common.dropped(mentions, told, everywhere)
    return out


def _shape(term: Column) -> Column:
    return F.when(term.rlike(r"^\p{N}+$"), "number").when(term.rlike(r"\p{N}"), "code").when(term.rlike(r"^\p{Lu}"), "name").otherwise("word")


def _told_spans(text: Column, spans: Column, told: Column) -> Column:
    """The spans of the told terms of a text, by start."""

    def placed(kinds: Column) -> Column:
        kind = lambda m: let(F.element_at(kinds, F.lower(m)), lambda k: F.when(k == "generalise", _shape(m)).otherwise(k))
        return F.transform(matches(_blanked(text, spans), TERM), lambda m: F.struct(m["start"].alias("start"), kind(m["m"]).alias("kind"), (m["start"] + F.length(m["m"])).cast("int").alias("end"), F.lower(m["m"]).alias("value")))

    return F.when(told.isNull(), F.array().cast(_SPAN)).otherwise(let(told, lambda kinds: F.filter(placed(kinds), lambda s: s["kind"].isNotNull())).cast(_SPAN))


def _rewritten(text: Column, spans: Column) -> Column:
    """text with the spans (by start) replaced; of overlapping spans the first gives the label, and all of their text goes."""
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))

    def step(a: Column, s: Column) -> Column:
        fresh = F.array_append(F.array_append(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"])), F.element_at(label, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text)))))


def sanitise(df: DataFrame, text: str = "text", keep: list[str] | None = None, generalise: float = GENERALISE, remove: float = REMOVE, deviations: float = DEVIATIONS, spread: int = SPREAD, into: tuple[str, str, str] = ("base", "terms", "clean")) -> DataFrame:
    """The columns keep of df (all by default) with three new ones, named by into: the spans of the patterns, the spans of disclosing terms (of TERM_KINDS), and the text rewritten.

    A null text has no spans and stays null; an empty one stays empty. Equal
    texts are treated alike. Repeated rows stay; an empty table gives an empty
    table. Columns of df with the new names are replaced; choose other names to
    keep them. Only texts with told terms move.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in into}]
    told = disclosing(df, text, generalise, remove, deviations, spread)
    body, key, kinds = (common.free_name(df, n) for n in ("body", "key", "kinds"))
    rows = df.select(*(F.col(c) for c in keep), F.col(text).alias(body)).withColumn(key, _text_key(F.col(body)))
    named = told.select(F.col("key").alias(key), F.col("told").alias(kinds))
    nothing = F.lit(None).cast("map<string,string>").alias(kinds)
    n = told.count()
    if not n:
        joined = rows.select("*", nothing)
    elif n <= common.FEW_KEYS:
        keys = F.broadcast(named.select(key))
        joined = rows.join(keys, key, "left_anti").select("*", nothing).unionByName(rows.join(keys, key, "left_semi").join(named, key))
    else:
        # an empty text has no terms; such rows get keys of their own so that they spread
        spread_out = F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.col(key)).otherwise(F.monotonically_increasing_id())
        joined = rows.withColumn(key, spread_out).join(named, key, "left")
    base, terms, clean = into
    out = joined.withColumn(base, base_spans(F.col(body))).withColumn(terms, _told_spans(F.col(body), F.col(base), F.col(kinds)))
    return out.withColumn(clean, _rewritten(F.col(body), F.sort_array(F.concat(base, terms)))).select(*keep, *into)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and disclosing terms replaced; n_chars follows the text. Nulls, repeated rows and empty tables as in sanitise; columns of any name pass."""
    into = tuple(common.free_name(docs, n) for n in ("base", "terms", "clean"))
    text = F.col(into[2])
    new = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text)).cast("long")}
    return sanitise(docs, into=into).select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_disclosure_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; a null text counts as an empty one."""
    out = sanitise(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rank = F.create_map(*(F.lit(x) for i, k in enumerate([*KINDS, *TERM_KINDS]) for x in (k, i)))
    named = F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), F.when(F.element_at(rank, s["kind"]) < len(KINDS), s["kind"]).otherwise("term").alias("kind"), s["end"].alias("end")))
    return out.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.sort_array(named)).alias("spans"))


QUERIES = {"op2_disclosure_terms": op2_disclosure_terms}
ORACLE: dict[str, str] = {}
