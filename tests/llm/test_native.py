"""Quality rules, personal data, URL lists, licence rules and sharding."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from sonarium.llm import licenses, pii, quality, sharding, urlfilter

from . import brute

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c a b c a b c",
    "line\nline\n\nline \nother",
    "the quick brown fox " * 30,
    "word " * 60,
    "### $$$ symbols&more|<>" * 5,
    "Ünïcode straße naïve \x0b\x0c\r words",
    "x" * 200_000,
]


def docs(spark, texts, **extra):
    schema = "doc_id long, text string" + "".join(f", {k} string" for k in extra)
    return spark.createDataFrame([(i, t, *(extra.values())) for i, t in enumerate(texts)], schema)


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab cd ef gh ij".split()) + rng.choice(["", "\n", ".", "#"]) for _ in range(rng.randrange(200))) for _ in range(30)]
    for r in quality.judge(docs(spark, texts, kept="x")).collect():
        want = brute.counts(texts[r.doc_id])
        assert tuple(r.features[k] for k in quality.FEATURES[:5]) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_posteriors_equal_plain_expectation_maximisation(spark):
    import math

    rng = random.Random(2)
    n = Counter()
    for _ in range(500):
        good = rng.random() < 0.8
        n[tuple(0 if rng.random() < 0.2 else (1 if rng.random() < (0.95 if good else 0.3) else -1) for _ in range(4))] += 1
    df = spark.createDataFrame([(list(v), c) for v, c in n.items()], "votes array<int>, n long")
    got = {tuple(r.votes): r.posterior for r in quality.posteriors(df).collect()}
    k, prior, g, b = 4, quality.START_PRIOR, [quality.START_GOOD] * 4, [quality.START_BAD] * 4
    inside = lambda x: min(max(x, quality.LOWEST), quality.HIGHEST)

    def post(v):
        s = math.log(prior / (1 - prior))
        for x, p, q in zip(v, g, b, strict=True):
            s += math.log(p / q) if x > 0 else math.log((1 - p) / (1 - q)) if x < 0 else 0
        return 1 / (1 + math.exp(-s))

    for _ in range(quality.ITERATIONS):
        e = [(v, c, post(v)) for v, c in n.items()]

        def chance(j, w, start):
            said = sum(c * w(p) for v, c, p in e if v[j] > 0)
            return inside((said + start * quality.STRENGTH) / (sum(c * w(p) for v, c, p in e if v[j]) + quality.STRENGTH))

        new_g, b = [chance(j, lambda p: p, quality.START_GOOD) for j in range(k)], [chance(j, lambda p: 1 - p, quality.START_BAD) for j in range(k)]
        g = [max(x, y) for x, y in zip(new_g, b, strict=True)]
        prior = inside(sum(c * p for _, c, p in e) / sum(c for _, c, _ in e))
    assert got.keys() == n.keys()
    assert all(abs(got[v] - post(v)) < 1e-9 for v in n)


def test_bad_texts_go_and_good_ones_stay(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.op3_weak_supervision(spark, sf_dir).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.2 * max(1, n.get((0, False), 0))


def test_empty_tables(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert quality.judge(empty).count() == 0
    assert pii.sanitise(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    captures = spark.createDataFrame([(1, "http://a.com/x", date(2024, 1, 1))], "id long, url string, fetched date")
    listed = spark.createDataFrame([("a.com", "spam", "block", date(2024, 1, 1), True)], "entry string, category string, action string, at date, added boolean")
    assert urlfilter.judge(captures.limit(0), listed).count() == 0
    assert [r.verdict for r in urlfilter.judge(captures, listed.limit(0)).collect()] == ["none"]


def test_stages_keep_clashing_columns_and_take_nulls(spark, sf_dir):
    import corpus_pipeline

    good = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    clash = ["kept", "votes", "features", "posterior", "base", "terms", "clean", "key", "kinds", "body", "row", "own", "goes", "component", "item"]
    df = good.unionByName(good.limit(3)).unionByName(good.limit(1).select(*(F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns)))
    df = df.select("*", *(F.lit(f"{c}!").alias(c) for c in clash))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns and {tuple(r) for r in out.select(*clash).distinct().collect()} <= {tuple(f"{c}!" for c in clash)}
        assert stage(spark, df.limit(0), sf_dir).count() == 0
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, df, sf_dir).count() == df.count() and packed(spark, df.limit(0), sf_dir).count() == 0


PERSONAL = TEXTS + [
    "mail a.b@c.de, x@y, q@r.s_t@u.v.w. end",
    "a@b.c_d@e.f and %%@z.q.",
    "1.2.3.4 256.1.1.1 01.002.0003.4 1.2.3.4.5.6.7.8 999.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 then 41111111111111111111111",
    "+1 (988) 555-2485, +49.30.123456789, +1 2, ++12345678901, +123456789012345678",
    "é 4111111111111111 ü +1 988 555 2485",
    "a@" * 3000 + "b.c",
    "1." * 30_000,
    "+" * 500 + "1" * 12,
    "9" * 50_000,
    "x@" + "a." * 20_000 + "com",
]


def test_spans_equal_brute_force(spark):
    df = docs(spark, PERSONAL, base="x", key="y").unionByName(docs(spark, PERSONAL[:3], base="x", key="y"))
    out = pii.sanitise(df)
    assert out.count() == len(PERSONAL) + 3
    for r in out.collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base)
        assert got == brute.spans(PERSONAL[r.doc_id]), PERSONAL[r.doc_id][:60]
        assert (r.clean is None) == (PERSONAL[r.doc_id] is None)
        if not r.base:
            assert r.clean == PERSONAL[r.doc_id]


def test_disclosing_terms_are_found_and_hidden(spark):
    rng = random.Random(4)
    filler = [f"common{c}" for c in "abcdefghij"]
    texts = [" ".join(rng.choice(filler) for _ in range(30)) for _ in range(200)]
    for i in range(6):
        texts[i] += f" note{i:03d} Zanzibarian reaches bob@mail.example.com today commona"
    rows = pii.sanitise(docs(spark, texts), keep=["doc_id"]).where(F.size("base") > 0).collect()
    assert len(rows) == 6
    for r in rows:
        words = [texts[r.doc_id][t.start : t.end] for t in r.terms]
        assert {"Zanzibarian", "reaches", "today"} <= set(words) and "commona" not in words
        assert "bob@" not in r.clean and "Zanzibarian" not in r.clean and "[EMAIL]" in r.clean


def test_disclosing_terms_are_hidden_wherever_they_stand(spark):
    rng = random.Random(7)
    filler = [f"common{c}" for c in "abcdefghij"]
    line = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [line(30) for _ in range(400)]
    for i in range(60):
        texts[i] = f"Ann {line(40)} no k77x {line(40)} bob@mail.example.com {texts[i]}"
    texts[80] = f"{line(5)} ANN and K77x {line(5)}"
    rows = {r.doc_id: r for r in pii.sanitise(docs(spark, texts, kinds="x"), keep=["doc_id", "kinds"]).collect()}
    for i in [*range(60), 80]:
        words = {texts[i][t.start : t.end].lower() for t in rows[i].terms}
        assert {"ann", "k77x"} <= words and not words & set(filler)
        assert not {"ann", "k77x"} & set(rows[i].clean.lower().split())
    assert all(rows[i].clean == texts[i] for i in range(60, 400) if i != 80)


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_term_spans_equal_brute_force(spark, monkeypatch, few):
    """Also where the sides are too large to be broadcast."""
    monkeypatch.setattr(pii.common, "FEW_KEYS", few)
    rng = random.Random(11)
    vocabulary = [f"{rng.choice(['w', 'N', 'é'])}{i}{rng.choice(['', 'x'])}" for i in range(60)] + [str(i) for i in range(20)] + ["Word", "wörd", "alt"]
    people = ["a@b.example", "+49 30 1234567 89", "10.1.2.3"]
    texts = []
    for _ in range(160):
        words = rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(12))
        for i, who in enumerate(people):
            if rng.random() < 0.15:
                words.insert(rng.randrange(len(words) + 1), who)
                words += [f"Friend{i}", f"{i}only{i}"][: rng.randrange(3)]
        texts.append("; ".join(words))
    texts += texts[:25] + [None, ""]
    got = pii.sanitise(docs(spark, texts, terms="x"), generalise=0.3, remove=0.6, deviations=1.0).collect()
    want, kinds = brute.term_spans(texts, 0.3, 0.6, 1.0, pii.SPREAD), set()
    for r in got:
        assert [(t.start, t.end, t.kind) for t in r.terms] == want[r.doc_id], texts[r.doc_id]
        kinds |= {t.kind for t in r.terms}
        if texts[r.doc_id]:
            assert r.clean == brute.rewritten(texts[r.doc_id], [(b.start, b.end, f"[{b.kind.upper()}]") for b in r.base] + [(t.start, t.end, "" if t.kind == "remove" else f"[{t.kind.upper()}]") for t in r.terms])
    assert len(got) == len(texts) and kinds >= {"remove", "number", "code", "name"}


def test_terms_of_entities_of_one_text_are_found(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = pii.op2_disclosure_terms(spark, sf_dir).where("spans LIKE '%term:%'").collect()
    assert rows
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet')").fetchall())
    for r in rows:
        base = [x.split(":") for x in r.spans.split(",") if not x.startswith("term:")]
        for _, s, e in (x.split(":") for x in r.spans.split(",") if x.startswith("term:")):
            assert texts[r.doc_id][int(s) : int(e)].isalnum()
            assert all(int(e) <= int(b[1]) or int(b[2]) <= int(s) for b in base)


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", ""]
    events = [(rng.choice(["a.com", "b.a.com", "d.org", "d.org/x", "d.org/x/y", "com", None]), rng.choice(["spam", "ok"]), rng.choice(["block", "allow"]), date(2024, 1, rng.randrange(1, 29)), rng.random() < 0.7) for _ in range(60)]
    captures = [(i, None if i == 0 else f"http://U:p@{rng.choice(hosts).upper()}:80/{rng.choice(['x', 'y', '', 'x/y', 'x//y', 'x/y/z'])}?q", None if i == 1 else date(2024, 1, rng.randrange(1, 31))) for i in range(80)] + [(2, "http://a.com/x", date(2024, 1, 9))] * 2
    captures += [(90, "http://" + "deep." * 3000 + "a.com/" + "x/" * 3000, date(2024, 1, 15))]
    ev = spark.createDataFrame(events, "entry string, category string, action string, at date, added boolean")
    cap = spark.createDataFrame([(*c, "h") for c in captures], "id long, url string, fetched date, host string")
    state = defaultdict(dict)
    for e, c, a, at, added in events:
        if e:
            state[e, c, a][at] = state[e, c, a].get(at, False) or added
    got = sorted(((r.id, r.url or "", str(r.fetched), r.verdict, r.entry or "") for r in urlfilter.judge(cap, ev).collect()))
    want = []
    for i, url, day in captures:
        best = None
        if url and day:
            host, _, path = url.split("@")[-1].removeprefix("http://").partition("/")
            host = host.split(":")[0].lower()
            directories = path.split("?")[0].split("/")
            directories = directories[: directories.index("")] if "" in directories else directories
            labels = host.split(".")
            names = [".".join(labels[j:]) for j in range(len(labels))][-9:] + [f"{host}/{'/'.join(directories[:j])}" for j in range(1, min(4, len(directories) + 1))] if host else []
            for (e, c, a), days in state.items():
                before = [d for d in days if d <= day]
                if e in names and before and days[max(before)]:
                    best = min(filter(None, [best, (-len(e), a, c, e)]))
        want.append((i, url or "", str(day), best[1] if best else "none", best[3] if best else ""))
    assert got == sorted(want)


def test_licence_rules(spark):
    mit = "\n".join(["Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal in\nthe Software without restriction, including without limitation the rights to use,\ncopy, modify, merge, publish, distribute, sublicense, and/or sell copies of the\nSoftware, and to permit persons to whom the Software is furnished to do so,\nsubject to the following conditions:", "", "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", "", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."])
    texts = [None, "", mit, "no end of line\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0. Other words", mit.split("\n\n")[2], "Released under the MIT License." * 2]
    texts += ["filler words. " * 60_000 + mit]
    df = docs(spark, texts, ids="clash")
    got = [r.license for r in licenses.scan(df.unionByName(df)).orderBy("doc_id").collect()]
    assert got == [x for x in [None, None, "MIT", "MIT", "Apache-2.0", None, None, "MIT"] for _ in range(2)]


def test_identifiers_are_compared_whole(spark):
    sentences = {"a-b": "first", "aXb": "second", "a_b": "third", "a,b": "fourth"}
    rules = [("L1", ["a_b"]), ("L2", ["a-b", "a,b"]), ("L3", ["a%"]), ("L4", ["a,b", "a-b"]), ("L5", []), ("L6", ["a-b", "a-b"])]
    rows = licenses.scan(docs(spark, ["First. Second.", "First. x. Fourth.", "third\n\n", "First. First."]), sentences=sentences, rules=rules).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == [[], ["L2"], ["L1"], ["L6"]]


def test_standard_headers_name_their_licence(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    hope = "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n'
    as_is = 'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
    gpl2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    agpl, lgpl = (gpl.replace("GNU", f"GNU {x}") for x in ("Affero", "Lesser"))
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    rows = licenses.scan(docs(spark, [gpl, f"{gpl}\n\n{hope}", apache, apache + as_is, gpl2, agpl, lgpl, mpl])).orderBy("doc_id").collect()
    assert [r.license for r in rows] == ["GPL-3.0-or-later"] * 2 + ["Apache-2.0"] * 2 + ["GPL-2.0-or-later", "AGPL-3.0-or-later", "LGPL-3.0-or-later", "MPL-2.0"]
    assert rows[1].sentence_ids == ["gpl-program", "gpl-terms-3", "gpl-hope", "gpl-implied", "gpl-see"]
    assert rows[3].sentence_ids == ["apache-header", "apache-compliance", "apache-as-is", "apache-see"]


def test_shards(spark):
    rng = random.Random(6)
    texts = ["hot " * 20] * 700 + ["w" * rng.randrange(300) for _ in range(1300)] + [None, ""]
    df = docs(spark, texts, key="a", sub="b", shard="c").unionByName(spark.createDataFrame([(None, "same", "a", "b", "c")] * 300, "doc_id long, text string, key string, sub string, shard string"))
    rows = sharding.shard_documents(df, 7, rows_per_cell=50).collect()
    assert len(rows) == len(texts) + 300
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r["size"] == len((r.text or "").encode()) + 8
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 7
    assert max(abs(s - mean) for s in sizes.values()) <= 0.02 * mean + 320


def test_shard_query(spark, sf_dir):
    rows = {r.doc_id: r for r in sharding.op10_histogram_sort(spark, sf_dir).collect()}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet')").fetchall():
        data = (text or "").encode()
        assert (rows[doc_id]["size"], rows[doc_id].text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert {(r.law, r.grown_shard) for r in rows.values()} == {("bytes", None)}


def test_personal_data_query(spark, sf_dir):
    rows = {r.doc_id: r for r in pii.op2_disclosure_terms(spark, sf_dir).collect()}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet')").fetchall():
        want = brute.spans(text)
        assert rows[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(rows[doc_id].spans.split(","))


@pytest.mark.parametrize("name", ["op4_temporal_list", "op5_sentence_rules", "op1_segment_reassembly"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    from sonarium.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = registry.QUERIES[name](spark, sf_dir)
    want = con.sql(registry.ORACLE[name])
    order = [list(want.columns).index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
