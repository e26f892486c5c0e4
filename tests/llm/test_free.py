"""WARC, near-duplicates, decontamination, packing, HTML, and the pipeline."""

import gzip
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from sonarium.llm import common, components, decontaminate, html, neardup, packing, warc

from . import brute


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def words(rng, n):
    return [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(3000)}" for _ in range(n)]


# WARC


def test_pages_come_back_from_archives(spark):
    rng = random.Random(1)
    pages = [(1, "http://a/\r\n1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000), (5, "u", "x" * 40_000), (None, "u", "same"), (41, "u", "y" * 3_000_000), (42, "u", "same"), (42, "u", "same")]
    pages += [(i, "u", "".join(rng.choice("abc\n ") for _ in range(rng.randrange(200)))) for i in range(6, 40)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    path = common.shared_path(spark, "warc-test")
    warc.archive_pages(df, path)
    got = warc.messages(spark, path).collect()
    assert len(got) == len(pages) and {r.status for r in got} == {"ok"}
    assert warc.read_records(spark, path).where("segment_number > 1000").count()
    empty = common.shared_path(spark, "warc-empty")
    warc.archive_pages(df.limit(0), empty)
    assert warc.messages(spark, empty).count() == 0
    responses = sorted((r.row_id or -1, bytes(r.payload)) for r in got if r.warc_type == "response")
    keeper = {}
    for i, _, h in pages:
        if i is not None:
            keeper[h or ""] = max(i, keeper.get(h or "", i))
    assert responses == sorted((i or -1, (h or "").encode()) for i, _, h in pages if i is None or i == keeper[h or ""])
    assert sorted((r.row_id, r.refers_to_row) for r in got if r.warc_type == "revisit") == sorted((i, keeper[h or ""]) for i, _, h in pages if i is not None and i < keeper[h or ""])


def test_segments_are_verified(spark):
    def segment(n, origin, block, total=None):
        return (f"r{origin}" if n == 1 else f"c{origin}{n}", "response" if n == 1 else "continuation", None, origin if n == 1 else None, None, None, n, None if n == 1 else f"r{origin}", total, bytearray(block))

    rows = [segment(2, 1, b"cd", 4), segment(1, 1, b"ab"), segment(2, 1, b"cd", 4), segment(1, 2, b"ab"), segment(3, 2, b"ef", 6), segment(1, 3, b"ab"), segment(2, 3, b"c", 4)]
    rows += [segment(i, 4, bytes([i]), 12 if i == 12 else None) for i in range(12, 0, -1)]
    got = {r.record_id: (r.status, bytes(r.block)) for r in warc.reassemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()}
    assert got["r1"] == ("ok", b"abcd") and got["r2"][0] == "missing" and got["r3"][0] == "length" and got["r4"] == ("ok", bytes(range(1, 13)))


def test_chunks():
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == (b"abc", "ok")
    assert warc.dechunk(b"5\r\nabc") == (b"", "chunks")
    assert warc.dechunk(b"3\r\nabcX") == (b"abc", "chunks")
    assert warc.dechunk(b"") == (b"", "chunks")


def test_archives_of_several_members():
    record = b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_archive(gzip.compress(record) + gzip.compress(record * 2))] == [b"abc"] * 3
    assert [b for _, b in warc.parse_archive(record)] == [b"abc"]
    for bad in (record[:-8], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


# near-duplicates


def near_rows(rng):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "ÉTÉ été"), (7, "été ÉTÉ")]
    for g in range(12):
        base = words(rng, rng.choice([8, 30, 120]))
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 8)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 1))
            rows.append((len(rows), " ".join(w)))
    hub = words(rng, 60)
    for i in range(45):
        w = list(hub)
        for j in rng.sample(range(60), 3 + i % 3):
            w[j] = f"edit{i}x{j}"
        rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "FEW", 6)
    rows = near_rows(random.Random(k))
    df = docs(spark, [(*r, "a", "b") for r in rows], ", row string, node string")
    got = {r.id: r for r in neardup.near_duplicates(df, k).collect()}
    want = brute.components(rows, k)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(brute.shingles(dict(rows)[d], k)) and r.kept == (want[d] == d) for d, r in got.items())


def test_repeated_and_null_ids(spark):
    text = " ".join(words(random.Random(9), 40))
    got = neardup.near_duplicates(docs(spark, [(7, text), (7, text), (None, text), (3, text), (3, text), (3, text + " more"), (None, None), (None, "")]), 5).collect()
    assert sorted((r.id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (3, 3), (3, 3), (7, 3), (7, 3)]
    assert sorted((r.id or -1, r.n_shingles > 0) for r in got if r.kept) == [(-1, False), (-1, False), (3, True)]
    assert neardup.near_duplicates(docs(spark, [(1, "x")]).limit(0), 5).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(words(random.Random(9), 40))
    rows = [(7, text, "a"), (7, text, "a"), (3, text, "b"), (3, text, "b"), (3, text, "c"), (None, text, "d"), (5, None, "e"), (5, None, "e"), (None, "", "f"), (8, "x" * 300_000 + " alone", "g")]
    df = docs(spark, rows, ", row string")
    got = sorted(((r.doc_id or -1), (r.text or "")[:9], r.row) for r in neardup.one_of_each(df).collect())
    assert len(got) == 5 and got[0] == (-1, "", "f") and got[1][0] == 3 and got[1][2] in "bc" and got[2:4] == [(5, "", "e")] * 2 and got[4][0] == 8
    assert neardup.one_of_each(df).columns == df.columns and neardup.one_of_each(df.limit(0)).count() == 0


def test_splits_of_the_source_change_nothing(spark, sf_dir, monkeypatch):
    """Between the steps the source is read in other splits, as when executors come and go."""
    path, asked = common.shared_path(spark, "split-docs"), []
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(8).write.parquet(path)
    write = common.written

    def written(df, name):
        asked.append(name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str((1 << 27) >> (14 * (len(asked) % 2))))
        return write(df, name)

    def found():
        df = neardup.near_duplicates(spark.read.parquet(path), 2)
        return sorted((r.id, r.component_id, r.kept) for r in df.collect()), sorted(r.doc_id for r in neardup.one_of_each(spark.read.parquet(path), 2).collect())

    want = found()
    monkeypatch.setattr(common, "written", written)
    try:
        got = found()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert asked and got == want and want[1] == [d for d, c, k in want[0] if k]


def test_near_duplicate_query_equals_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").collect()]
    want = brute.components(rows, 2)
    got = neardup.op6_tensored_banding(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute.shingles(dict(rows)[r.doc_id], 2)) for r in got)


def test_large_star_small_star(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (1, 2), (2, 1)]
    parent = list(range(200))
    for u, v in edges:
        a, b = u, v
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for u, v in edges if u != v for x in (u, v)}


def test_components_plan_little_on_the_driver(spark, monkeypatch):
    """Two steps read their links four times, links that are stars need no step, and a path ends at stars without one step more."""
    edges = spark.createDataFrame([(2, 1), (3, 1), (9, 8)], "u long, v long")
    two = components._star(components._star(edges, True), False)
    assert two._jdf.queryExecution().analyzed().collectLeaves().size() <= 4
    assert sorted(map(tuple, two.collect())) == [(2, 1), (3, 1), (9, 8)]
    asked, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: asked.append(name) or write(df, name))
    assert sorted(map(tuple, components.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)] and asked == ["links"]
    asked.clear()
    path = spark.createDataFrame([(2, 1), (3, 2), (None, 3), (7, 7)], "u long, v long")
    assert sorted(map(tuple, components.components(path).collect())) == [(1, 1), (2, 1), (3, 1)] and asked == ["links", "stars"]
    assert components.components(path.limit(0)).count() == 0


# decontamination


def test_containment_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 16, 17, 40, 90, 300])] + [(50, None), (51, ""), (52, "...")]
    items += [(60 + i, " ".join((words(rng, n) * 300)[:m])) for i, (n, m) in enumerate([(10, 100), (10, 200), (6, 60), (1, 500)])]
    rows = [(0, None), (1, "")]
    for _ in range(60):
        parts = words(rng, rng.randrange(3000))
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").upper().split()
            cut = rng.choice([0, 0, len(w) // 10, len(w) // 3])
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = [x + rng.choice(["", ",", "!"]) for x in w[cut:]]
        rows.append((len(rows), " ".join(parts)))
    rows += [rows[5], (900, " ".join(words(rng, 90_000) + items[9][1].split() + words(rng, 5))), (901, " ".join(words(rng, 3000) + items[-1][1].split()[:20]))]
    sh = lambda t: brute.shingles("".join(c if c.isalnum() else " " for c in t or ""), 5)
    flat = lambda t: " " + " ".join(brute.WORD.findall(brute.lower("".join(c if c.isalnum() else " " for c in t or "")))) + " "
    want = Counter()
    for d, t in rows:
        own = sh(t)
        for i, text in items:
            q = sh(text)
            short = len(flat(text).split()) < 5
            if q and (flat(text) in flat(t) if short else len(q & own) >= 0.8 * len(q)):
                want[d, i] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect())
    assert got == want
    blocks = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench, per_block=4).collect())
    assert blocks == want
    left = [r.doc_id for r in decontaminate.clean(docs(spark, [(*r, "x") for r in rows], ", item_id string"), bench, per_block=4).collect()]
    assert sorted(left) == sorted(d for d, _ in rows if d not in {k for k, _ in want})
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_query_equals_brute_force(spark, sf_dir):
    clean = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t or "")
    items = [(r.item_id, brute.shingles(clean(r.text), 5)) for r in common.table(spark, sf_dir, "benchmark").collect()]
    want = {}
    for r in common.table(spark, sf_dir, "documents").collect():
        own = brute.shingles(clean(r.text), 5)
        want |= {(r.doc_id, i): len(q & own) for i, q in items if q and len(q & own) >= 0.8 * len(q)}
    got = decontaminate.op7_containment_search(spark, sf_dir).collect()
    assert want and {(r.doc_id, r.item_id): r.n_shared for r in got} == want and len(got) == len(want)


# packing


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 90_000), rng.randrange(1, 11)))
        counts = [rng.choice([1, 1, 2, 9, 5000]) for _ in lengths]
        totals = [a * b for a, b in zip(lengths, counts, strict=True)]
        most = rng.randrange(1, 6)

        def padding(tops):
            return sum(n * (min(t for t in tops if t >= x) - x) for x, n in zip(lengths, counts, strict=True))

        best = min(padding([*c, lengths[-1]]) for k in range(min(most, len(lengths))) for c in combinations(lengths[:-1], k))
        got = packing.boundaries(lengths, counts, totals, most)
        assert len(got) <= most and got == sorted(got) and padding(got) == best


def test_packing_query_is_optimal(spark, sf_dir):
    rows = packing.op8_length_buckets(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    lengths = {d: len(brute.WORD.findall(t or "")) for d, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in rows} == lengths and len(rows) == len(texts)
    tops = sorted({r.bucket_tokens for r in rows})
    assert all(r.bucket_tokens == min(t for t in tops if t >= r.n_tokens) for r in rows)
    counts = sorted(Counter(lengths.values()).items())
    cost = {(0, 0): 0}  # (lengths taken, buckets) to least padding, by plain dynamic programming
    for b in range(1, packing.N_BUCKETS + 1):
        for j in range(1, len(counts) + 1):
            pad, least = 0, None
            for i in range(j - 1, -1, -1):
                pad += counts[i][1] * (counts[j - 1][0] - counts[i][0])
                if (i, b - 1) in cost and (least is None or cost[i, b - 1] + pad < least):
                    least = cost[i, b - 1] + pad
            if least is not None:
                cost[j, b] = least
    assert sum(r.bucket_tokens - r.n_tokens for r in rows) == min(v for (j, _), v in cost.items() if j == len(counts))
    batches = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r.bucket_tokens)
    assert all(len(b) == 1 or sum(b) <= packing.TOKEN_BUDGET for b in batches.values())


def test_batches_keep_the_budget(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 3, 3, 40, 41, 900]))) for i in range(800)] + [(None, None)] * 300 + [(5, "w w"), (5, "w w"), (6, "w " * 150_000)]
    from pyspark.sql import functions as F

    got = packing.pack(docs(spark, [(*r, "x") for r in rows], ", bucket string"), packing.word_count(F.col("text")), 4, 100, rows_per_cell=20).collect()
    assert len(got) == len(rows)
    batches, slots = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.n_tokens == len((r.text or "").split()) <= r.bucket_tokens
        batches[r.bucket, r.batch].append(r)
        slots[r.bucket].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(b) == 1 or len(b) * b[0].bucket_tokens <= 100 for b in batches.values())
    assert packing.pack(docs(spark, rows[:1]).limit(0), F.lit(1)).count() == 0


def test_cells_are_in_order(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 200_000, 7).select("id", packing.cell_of(F.col("id")).alias("c")).collect()
    cells = [r.c for r in rows]
    assert cells == sorted(cells) and cells[:9000] == [r.id for r in rows[:9000]] and max(cells) < packing.EXACT + 3 * packing.STEPS + 1


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="ad-free"><nav><ul><li>menu</li></ul></nav>
<header>site</header><div class="ad">buy</div><!-- <p>no</p> --><article><h1>Head &amp; more</h1><header>by me</header><p><b>one<br><p>two&nbsp;<i>th</i>ree</p>
<div id="comments"><p>first!</p></div><form>f</form><p title="a>b">four</p></article><aside>side</aside><footer>&copy; foot</footer>"""


def test_blocks_of_a_page():
    marked, found = html.blocks(PAGE)
    assert marked and " ".join(t for k, t in found if k == html.MAIN) == "Head & more by me one two three four"
    assert html.blocks(None) == html.blocks("") == (False, [])
    assert html.blocks("<b>" * 5000 + "x" + "</i>" * 5000) == (False, [(html.OPEN, "x")])
    assert html.blocks("a < b <3 <")[1] == [(html.OPEN, "a < b <3 <")]


def stream(pages):
    """pages: lists of (kind, text)."""
    return html.part(["\n".join(t for _, t in p).encode() for p in pages], ["".join(k for k, _ in p) for p in pages])


def test_boilerplate_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        run = rng.choice([1, 3, 5])
        pages = [[(rng.choice("mco"), " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 5))]
        p = stream(pages)
        got = html.boilerplate(p, run)
        want = brute.boilerplate(pages, run)
        assert got.tolist() == [x for page in want for x in page], pages
        assert html.texts_of(p, got) == [brute.main_text(page, gone, html.LITTLE) for page, gone in zip(pages, want, strict=True)]


def test_boilerplate_goes_where_main_is_not_marked(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    own = [" ".join(f"p{n}w{i}" for i in range(9)) for n in range(6)]
    menu = "<div><div>Home</div><div>About us</div><div>Contact</div></div>"
    pages = [(n, "http://h.example/x", f"{menu}<div>{shared}</div><p>{own[n]}</p><div>All rights reserved</div>", "c") for n in range(6)]
    pages += [(9, None, None, "c"), (9, None, None, "c"), (10, "http://other.example", f"<p>{shared}</p>", "c"), (None, "http://h.example", PAGE, "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    for part_bytes in (html.PART_BYTES, 500):
        rows = html.extract(df, part_bytes=part_bytes).collect()
        assert len(rows) == len(pages)
        assert {r.page_id: r.text for r in rows} == {n: own[n] for n in range(6)} | {9: "", 10: shared, None: "Head & more by me one two three four"}
    assert html.extract(df.limit(0)).count() == 0


def test_markup_is_confirmed_and_overruled(spark):
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    notice, teaser, quote = words("notice", 20), words("teaser", 20), words("quote", 20)
    # a notice that one page marks as such; a teaser of one article in the sidebars of others; prose that two articles share
    pages = [(0, f"<article><p>{words('own0w', 30)}</p></article><aside>{notice}</aside><aside>{teaser}</aside>", words("own0w", 30))]
    pages += [(n, f"<article><p>{words(f'own{n}w', 30)}</p><p>{notice}</p></article><aside>{teaser}</aside>", words(f"own{n}w", 30)) for n in (1, 2)]
    pages += [(3, f"<article><p>{teaser}</p><p>{words('own3w', 30)}</p></article>", f"{teaser} {words('own3w', 30)}")]
    pages += [(n, f"<article><p>{words(f'own{n}w', 30)}</p><p>{quote}</p></article>", f"{words(f'own{n}w', 30)} {quote}") for n in (4, 5)]
    # unmarked: the notice and what only open blocks share go, prose of an article stays
    pages += [(n, f"<div>{notice}</div><div>{words(f'own{n}w', 30)}</div><div>{quote}</div><div>{words('foot', 18)}</div>", f"{words(f'own{n}w', 30)} {quote}") for n in (6, 7)]
    # copies count as one page; a marked teaser is too little
    pages += [(n, f"<div>{words('plain', 40)}</div>", words("plain", 40)) for n in (8, 9)]
    pages += [(10, f"<article>teaser only</article><p>{words('body', 50)}</p><p>{notice}</p>", "teaser only " + words("body", 50))]
    df = spark.createDataFrame([(n, "http://h.example/x", h) for n, h, _ in pages], "page_id long, url string, html string")
    for part_bytes in (html.PART_BYTES, 600):
        got = {r.page_id: r.text for r in html.extract(df, part_bytes=part_bytes).collect()}
        assert got == {n: want for n, _, want in pages}


def test_parts_of_a_host_change_nothing(spark):
    rng = random.Random(12)
    lines = [" ".join(f"{c}{i}" for i in range(rng.choice([2, 16, 25]))) for c in "abcdefgh"]
    own = lambda n: " ".join(f"own{n}w{i}" for i in range(30))
    tags = ["<article><p>{}</p></article>", "<div>{}</div>", "<aside>{}</aside>"]
    pages = [(n, "http://h.example/x", "".join(rng.choice(tags).format(rng.choice(lines)) for _ in range(4)) + f"<p>{own(n)}</p>") for n in range(80)]
    pages += [(n, "http://h.example/y", "<p>" + "long " * 60_000 + "</p>") for n in (80, 81)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in html.extract(df).collect()}
    assert len(want) == len(pages) and len(want[80]) == 5 * 60_000 - 1
    for part_bytes in (300, 3000):
        assert {r.page_id: r.text for r in html.extract(df, part_bytes=part_bytes).collect()} == want


def test_html_query_equals_a_plain_extractor(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in common.table(spark, sf_dir, "pages").collect()]
    want = brute.main_texts(rows, html.RUN, html.LITTLE)
    got = html.op9_host_suffix_array(spark, sf_dir).collect()
    assert sorted((r.page_id, r.url, r.text) for r in got) == sorted((i, u, want[i]) for i, u, _ in rows)
    assert all(r.n_chars == len(r.text) for r in got)


# pipeline


def test_pipeline_takes_effect(spark, sf_dir):
    import corpus_pipeline

    seen = common.table(spark, sf_dir, "documents")
    columns = seen.columns
    kept = [{r.doc_id: r.text for r in seen.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = common.written(stage(spark, seen, sf_dir), "test-" + name.replace(" ", "-"))
        assert seen.columns == columns
        kept.append({r.doc_id: r.text for r in seen.collect()})
    docs_, good, unique, clean, private = kept
    assert set(docs_) > set(good) > set(unique) >= set(clean) == set(private)
    comps = brute.components(sorted(good.items()), 5)
    assert set(unique) == {d for d, c in comps.items() if d == c}
    bench = [brute.shingles("".join(c if c.isalnum() else " " for c in r.text), 5) for r in common.table(spark, sf_dir, "benchmark").collect()]
    for d in unique:
        own = brute.shingles("".join(c if c.isalnum() else " " for c in unique[d]), 5)
        assert (d in clean) == (not any(len(q & own) >= 0.8 * len(q) for q in bench))
    for d, t in clean.items():
        assert (private[d] == t) == (brute.spans(t) == "")
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir).collect()
    assert sorted(r.doc_id for r in packed) == sorted(private)
