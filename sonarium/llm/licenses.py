"""Licence scans by sentences and ordered rules.

A text is cut into sentences, each normalised (lower case, letters and digits
only, single spaces) and mapped to the identifier of a known licence sentence,
if it is one. The identifiers in text order are then matched against rules,
each an ordered list of identifiers that may have other sentences between.
Lookup is by hash set; a text without known sentences meets no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

#: Normalised sentences of public licences and of the notices that name them.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-include": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software",
    "gpl-terms-3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-terms-3": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-terms-3": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-2-later": "either version 2 of the license or at your option any later version",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-nc-4-notice": "licensed under cc by nc 4 0",
    "cc-by-4-notice": "this work is licensed under a creative commons attribution 4 0 international license",
}

#: (licence, sentences in order); the first rule that matches names the licence, so longer rules stand before shorter ones.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("Apache-2.0", ["apache-header", "apache-compliance", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-as-is", "apache-see"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl-terms-3", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("MIT", ["mit-grant", "mit-include", "as-is"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl-terms-3"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl-terms", "gpl-2-later"]),
    ("AGPL-3.0-or-later", ["gpl-program", "agpl-terms-3"]),
    ("LGPL-3.0-or-later", ["gpl-program", "lgpl-terms-3"]),
    ("MPL-2.0", ["mpl-subject", "mpl-copy"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
]

#: A sentence ends at marks before white space, or at an empty line.
SENTENCE_END = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in order. A sentence may run over lines; one that is not known is tried line by line."""
    known = {v: k for k, v in sentences.items()}
    names = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    is_known = lambda s: s.isin(list(known))
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END, -1), lambda s: let(normalised(s), lambda n: F.when(is_known(n), F.array(n)).when(F.instr(s, "\n") > 0, F.filter(F.transform(F.split(s, "\n", -1), normalised), is_known)).otherwise(F.array().cast("array<string>"))))
    return F.transform(F.flatten(pieces), lambda n: F.element_at(names, n))


def scan(df: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """df with sentence_ids array<string>, licenses array<string> (all whose rules match, in rule order) and license (the first, else null).

    A null or empty text has no sentences and no licence; rows are judged one
    by one, so repeated rows, very long texts and empty tables need no care. A
    rule that names an unknown sentence, or none, never matches. Columns of df
    with the new names are replaced. The sentence table is part of the plan, so
    it is meant for some thousands of sentences at most.
    """
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    df = df.drop("sentence_ids", "licenses", "license")
    ids = common.free_name(df, "ids")

    def follows(found: Column, rule: list[str]) -> Column:
        """Whether the identifiers of a rule stand among those found, in order."""
        wanted = F.array(*map(F.lit, rule))
        return F.aggregate(found, F.lit(0), lambda i, x: F.when(F.get(wanted, i) == x, i + 1).otherwise(i)) == len(rule)

    def matched(found: Column) -> Column:
        names = [F.when(follows(found, rule), F.lit(name)) for name, rule in rules if rule and set(rule) <= set(sentences)]
        nothing = F.array().cast("array<string>")
        return F.when(F.size(found) == 0, nothing).otherwise(F.array_distinct(F.array_compact(F.array(*names).cast("array<string>"))))

    found = df.withColumn(ids, let(sentence_ids(F.col(text), sentences), lambda x: F.struct(x.alias("ids"), matched(x).alias("licenses"))))
    return found.select(*df.columns, F.col(ids)["ids"].alias("sentence_ids"), F.col(ids)["licenses"].alias("licenses"), F.get(F.col(ids)["licenses"], F.lit(0)).alias("license"))


def op5_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sentence_ids, licenses, license, n_sentences) of every document, lists joined by commas; a null text has none."""
    out = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "license", F.size("sentence_ids").cast("long").alias("n_sentences"))


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    norm = lambda s: f"trim(regexp_replace(lower({s}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    table = ", ".join(f"({quoted(v)}, {quoted(k)})" for k, v in SENTENCES.items())
    cases = ", ".join(f"CASE WHEN line LIKE {quoted('%' + '%'.join(f',{i},' for i in rule) + '%')} THEN {quoted(name)} END" for name, rule in RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {table}),
pieces AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[.!?;:]+[\\x20\\x09-\\x0D]+|\\n[\\x20\\x09-\\x0D]*\\n')) AS piece, generate_subscripts(string_split_regex(coalesce(text, ''), '[.!?;:]+[\\x20\\x09-\\x0D]+|\\n[\\x20\\x09-\\x0D]*\\n'), 1) AS p FROM documents),
whole AS (SELECT doc_id, p, 0 AS q, id FROM pieces JOIN known ON {norm("piece")} = sentence),
lines AS (SELECT doc_id, p, unnest(string_split(piece, chr(10))) AS line, generate_subscripts(string_split(piece, chr(10)), 1) AS q FROM pieces
  WHERE contains(piece, chr(10)) AND {norm("piece")} NOT IN (SELECT sentence FROM known)),
hits AS (SELECT * FROM whole UNION ALL SELECT doc_id, p, q, id FROM lines JOIN known ON {norm("line")} = sentence),
docs AS (SELECT doc_id, string_agg(id, ',' ORDER BY p, q) AS ids, count(*) AS n, ',' || string_agg(id, ',,' ORDER BY p, q) || ',' AS line FROM hits GROUP BY doc_id),
named AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS names FROM docs),
once AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS licenses FROM named)
SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(licenses, ','), '') AS licenses, licenses[1] AS license, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences
FROM documents d LEFT JOIN once o ON o.doc_id = d.doc_id"""


QUERIES = {"op5_sentence_rules": op5_sentence_rules}
ORACLE = {"op5_sentence_rules": _oracle()}
