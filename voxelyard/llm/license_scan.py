"""Licence recognition by sentences, with DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, runs of other characters than a-z
and 0-9 as one blank) and looked up among the known licence sentences. A known sentence may be
wrapped over several lines, also of a comment; n_sentences counts lines. What remains is a sequence
of sentence identifiers. A rule is an ordered sequence of identifiers; it applies where that
sequence stands in the document's, with no other known sentence between. Longer rules are tried
first, and what a rule has taken no other can take, so a licence's text isn't also the shorter one
that it begins with. A last rule (all rights reserved) holds only where no licence stands.

Defined results: a null or empty text has no sentences and no licence; very long texts are read whole;
repeated rows are each answered; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Sentences of published licences and of the usual notices, normalised.
SENTENCES: dict[str, str] = {
    "apache2_under": "licensed under the apache license version 2 0",
    "apache2_under_the_license": "licensed under the apache license version 2 0 the license",
    "apache2_may_not": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_released": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_name": "the mit license mit",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl3_under": "licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software",
    "gpl3_redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2_either": "either version 2 of the license or at your option any later version",
    "gpl3_either": "either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "cc_by_nc4": "licensed under cc by nc 4 0",
    "cc_by4": "licensed under cc by 4 0",
    "cc_by_sa4": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "cc_by4_long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc_by_nc4_long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3_under": "licensed under the bsd 3 clause license",
    "bsd2_under": "licensed under the bsd 2 clause license",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
}

# Each licence's rules, as sentences in their order.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2_under"]),
    ("Apache-2.0", ["apache2_under_the_license"]),
    ("Apache-2.0", ["apache2_may_not", "apache2_copy", "apache2_as_is", "apache2_see"]),
    ("MIT", ["mit_released"]),
    ("MIT", ["mit_under"]),
    ("MIT", ["mit_name"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("GPL-3.0-only", ["gpl3_work"]),
    ("GPL-3.0-only", ["gpl3_under"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_redistribute"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl2_redistribute"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl_redistribute", "gpl2_either"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_redistribute", "gpl3_either"]),
    ("CC-BY-NC-4.0", ["cc_by_nc4"]),
    ("CC-BY-NC-4.0", ["cc_by_nc4_long"]),
    ("CC-BY-4.0", ["cc_by4"]),
    ("CC-BY-4.0", ["cc_by4_long"]),
    ("CC-BY-SA-4.0", ["cc_by_sa4"]),
    ("CC0-1.0", ["cc0"]),
    ("BSD-2-Clause", ["bsd2_under"]),
    ("BSD-3-Clause", ["bsd3_under"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl2"]),
    ("Unlicense", ["unlicense"]),
]
LAST_RULE = ("LicenseRef-proprietary", ["rights"])  # only where no other applies
BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1]))

SENTENCE_END = "[.!?;:]+[ \\t\\r\\f]+|[\\n]+"
OTHER = "[^a-z0-9]+"
# A sentence that is wrapped ends at marks and at blank lines (without letters and digits, so that
# comments' empty lines are blank); STOP stands for these ends, FOLD for the other line ends. Each is
# written twice, so that a sentence has an end of its own on either side.
WHOLE_END = "[.!?;:]+[ \\t\\r\\f\\n]+|\\n[^a-z0-9]*\\n"
STOP, FOLD = "\x01", "\x02"
OTHER_MARKED = f"[^a-z0-9{STOP}{FOLD}]+"
WRAPPED = f"[{STOP}{FOLD}]({'|'.join(s.replace(' ', f'(?: |{FOLD}{FOLD})') for s in sorted(SENTENCES.values(), key=len, reverse=True))})[{STOP}{FOLD}]"


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_known, sentence_ids, licenses): identifiers in their order, joined
    by ``>``; licences by name, joined by `` AND ``. A projection of the scan: no shuffle, and
    no column but doc_id and text is read."""
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, name)])
    text = F.lower(F.coalesce("text", F.lit("")))
    sentences = F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, OTHER, " "))), lambda s: s != "")
    marked = F.regexp_replace(F.regexp_replace(F.translate(text, STOP + FOLD, "  "), WHOLE_END, STOP), "\\n", FOLD)
    marked = F.concat(F.lit(STOP), F.regexp_replace(marked, OTHER_MARKED, " "), F.lit(STOP))
    marked = F.regexp_replace(marked, f" ?([{STOP}{FOLD}]) ?", "$1$1")
    found = F.regexp_extract_all(marked, F.lit(WRAPPED), 1)
    ids = docs.select("doc_id", F.size(sentences).cast("long").alias("n_sentences"), F.transform(found, lambda s: F.element_at(known, F.replace(s, F.lit(FOLD + FOLD), F.lit(" ")))).alias("_i"))
    line = ids.select("doc_id", "n_sentences", F.size("_i").cast("long").alias("n_known"), F.array_join("_i", ">").alias("sentence_ids"), F.array_join(F.transform("_i", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("_s"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(seq)).alias("seq")) for name, seq in BY_LENGTH])
    start = F.struct(F.col("_s").alias("left"), F.array().cast("array<string>").alias("got"))
    taken = F.aggregate(rules, start, lambda acc, r: F.struct(F.replace(acc["left"], r["seq"], F.lit("|")).alias("left"), F.when(F.contains(acc["left"], r["seq"]), F.array_append(acc["got"], r["name"])).otherwise(acc["got"]).alias("got")))
    names = F.array_join(F.array_sort(F.array_distinct(taken["got"])), " AND ")
    rights = F.when(F.contains("_s", F.lit(_sequence(LAST_RULE[1]))), F.lit(LAST_RULE[0])).otherwise("")
    return line.withColumn("licenses", F.when(F.col("n_known") == 0, F.lit("")).otherwise(F.coalesce(F.nullif(names, F.lit("")), rights))).drop("_s")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _oracle() -> str:
    """The same in SQL: rules are taken one after the other from the line of identifiers."""
    q = _quoted
    steps = [f"replace(l{k}, {q(_sequence(seq))}, '|') AS l{k + 1}" for k, (_, seq) in enumerate(BY_LENGTH)]
    got = ", ".join(f"CASE WHEN contains(l{k}, {q(_sequence(seq))}) THEN {q(name)} END" for k, (name, seq) in enumerate(BY_LENGTH))
    chain = " ".join(f", t{k + 1} AS (SELECT *, {step} FROM t{k})" for k, step in enumerate(steps))
    known = ", ".join(f"{q(s)}: {q(n)}" for n, s in SENTENCES.items())
    last = f"CASE WHEN contains(l0, {q(_sequence(LAST_RULE[1]))}) THEN {q(LAST_RULE[0])} ELSE '' END"
    mark = lambda x: x.replace(STOP, r"\x01").replace(FOLD, r"\x02")
    return f"""
WITH s AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
p AS (SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(t, '{SENTENCE_END}'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '')) AS n,
  regexp_replace(regexp_replace(translate(t, chr(1) || chr(2), '  '), '{WHOLE_END}', chr(1), 'g'), '\\n', chr(2), 'g') AS m FROM s),
r AS (SELECT doc_id, n, regexp_replace(chr(1) || regexp_replace(m, '{mark(OTHER_MARKED)}', ' ', 'g') || chr(1), '{mark(f' ?([{STOP}{FOLD}]) ?')}', '\\1\\1', 'g') AS m FROM p),
known AS (SELECT MAP {{{known}}} AS k),
i AS (SELECT doc_id, n, list_transform(regexp_extract_all(m, '{mark(WRAPPED)}', 1), lambda x: k[replace(x, chr(2) || chr(2), ' ')]) AS ids FROM r, known),
t0 AS (SELECT *, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS l0 FROM i){chain}
SELECT doc_id, n::BIGINT AS n_sentences, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, '>'), '') AS sentence_ids,
  coalesce(nullif(coalesce(array_to_string(list_sort(list_distinct(list_filter([{got}], lambda x: x IS NOT NULL))), ' AND '), ''), ''), {last}) AS licenses
FROM t{len(steps)}"""


ORACLE = _oracle()
