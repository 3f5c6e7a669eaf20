"""The training-data operators against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelyard.llm import chat_format, decontaminate, fasttok, fingerprints, jaccard_join, language_id, license_scan, packing, stages, suffix_dedup, token_counts, token_store
from voxelyard.llm.common import Scratch, with_uid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    out = [(0, None), (1, ""), (2, "  \n "), (3, "a b"), (4, "A  b"), (5, "a" * 700), (6, "é" * 300), (7, "12 34"), (8, "<|endoftext|> it's 日本 x"), (8, "same id"), (9, " ".join(base) * 40)]
    for i in range(20, 60):
        x = list(base)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice(words)
        out.append((i, " ".join(x)))
    line = " ".join(rng.choice(words) for _ in range(9))
    out += [(i, line + " " + " ".join("z%d" % rng.randrange(10**6) for _ in range(rng.randint(1, 30)))) for i in range(60, 140)]
    out += [(i, out[30][1]) for i in range(140, 160)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None) for i, t in corpus()]
    # a further column whose name operators use themselves
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", bucket string").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ORDERED = sorted(corpus(), key=lambda x: (x[0], x[1] or ""))


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def test_jaccard(spark, docs, empty):
    sets = [(i, shingles(t)) for i, t in ORDERED]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    want = sorted((i, len(s), sets[find(k)][0]) for k, (i, s) in enumerate(sets))
    scratch = Scratch(spark, "t")
    got = jaccard_join.with_doc_ids(scratch.keep(jaccard_join.jaccard_components(with_uid(docs, scratch), scratch)))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert jaccard_join.jaccard_components(with_uid(empty, scratch), scratch).count() == 0


def test_suffix_dedup(spark, docs, empty):
    seen, want = set(), []
    for i, t in ORDERED:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        m = np.append(0, gone.astype(int))
        want.append((i, len(b), int(gone.sum()), int((np.diff(m) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    scratch = Scratch(spark, "t")
    got = suffix_dedup.remove_repeats(with_uid(docs, scratch), scratch).drop("uid")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert suffix_dedup.remove_repeats(with_uid(empty, scratch), scratch).count() == 0


def repeats(texts):
    """doc_id to removed bytes, by a set of all strings seen."""
    seen, want = set(), {}
    for i, t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i] = int(gone.sum())
    return want


def test_crowded_lines_and_long_texts(spark, monkeypatch):
    """A line of many unlike documents, which is split, and a text of several blocks."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 12)
    rng = random.Random(11)
    line = told(rng, 20)
    texts = [(i, f"{told(rng, rng.randint(2, 9))} {line} {told(rng, rng.randint(2, 9))}") for i in range(150)]
    texts.append((200, f"{told(rng, 3000)} {line} {told(rng, 2000)} {line}"))
    scratch = Scratch(spark, "t")
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(with_uid(rows, scratch), scratch).collect()}
    assert got == repeats(texts)


def test_the_transform_decides():
    """Strands of one anchor that share windows: what goes comes from the transform's order alone."""
    rng = random.Random(12)
    text = told(rng, 40).encode()
    parts = [text[:160], text[20:180], text[50:190], told(rng, 30).encode()[:150]]
    size = np.array([len(p) for p in parts])
    start = np.append(0, np.cumsum(size))[:-1]
    who, where, group = suffix_dedup.equal_windows(np.frombuffer(b"".join(parts), np.uint8), start, size)
    by = defaultdict(set)
    for k, p, g in zip(who.tolist(), where.tolist(), group.tolist(), strict=True):
        by[g].add(parts[k][p : p + 100])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({p[i : i + 100] for p in parts for i in range(len(p) - 99)})


def test_repeats_need_the_transform(spark, monkeypatch):
    rng = random.Random(13)
    base = told(rng, 40)
    texts = [(i, f"{told(rng, 5)} {base} {told(rng, 5)}") for i in range(4)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    folder = Scratch(spark, "t")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(with_uid(rows, folder), folder).collect()} == repeats(texts)
    z = np.zeros(0, np.int64)
    monkeypatch.setattr(suffix_dedup, "equal_windows", lambda *_: (z, z, z))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(with_uid(rows, folder), folder).collect()}
    assert got != repeats(texts)


def test_transform_on_files(tmp_path, monkeypatch):
    texts = [b"banana" * 20, b"ananas" * 20, b"bandana" * 18]
    size = np.array([len(t) for t in texts])
    start = np.append(0, np.cumsum(size))[:-1]
    blob = np.frombuffer(b"".join(texts), np.uint8)
    want = suffix_dedup.transform(blob, start, size, str(tmp_path))
    monkeypatch.setattr(suffix_dedup, "TAPE", 10)
    got = suffix_dedup.transform(blob, start, size, str(tmp_path))
    suffixes = sorted([(t[i:], k) for k, t in enumerate(texts) for i in range(len(t) + 1)])
    lcp = [0] + [next((n for n, (x, y) in enumerate(zip(a[0], b[0], strict=False)) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and want[1].tolist() == lcp


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens(name):
    import pyarrow as pa

    rng = random.Random(3)
    texts = [t or "" for _, t in corpus()] + ["it's I'm 'tis !'s\n's", "a  b\n\n c\t\td  ", "½ x² ª"] + ["".join(rng.choice("ab '\n1!sStTdlLreve\té ") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    tok = fasttok.load(fasttok.vocabulary(name))
    got = []
    for i, j, ids, ends in tok.tokens(pa.array(texts), 2000):
        got += [ids[ends[k] : ends[k + 1]].tolist() for k in range(j - i)]
    assert got == [x.ids for x in tok.lib.encode_batch(texts, add_special_tokens=False)]


def ids_of(name, text):
    return fasttok.load(fasttok.vocabulary(name)).lib.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, empty):
    want = sorted((i, len((t or "").encode()), len(ids_of("byte_bpe_50k.json", t))) for i, t in corpus())
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs).collect()) == want
    assert token_counts.token_counts(empty).count() == 0


def test_prefix_table():
    for t in ["Hello  world\n\nit's 12 a   ", "x \n y", ""]:
        table = token_counts.PrefixTable(t)
        assert [table.count(n) for n in range(len(t) + 1)] == [len(ids_of("byte_bpe_50k.json", t[:n])) for n in range(len(t) + 1)]


def test_prefix_tables_of_texts(spark):
    texts = ["x  <|endoftext|> y", "a <|endoftext|><|endof", "it'll  'll'", "日本 語  x\n\n y", "", None, "  \n x" + "é" * 9, "a" * 200 + "\t\tq"]
    got = {r["doc_id"]: r["prefix"] for r in token_counts.prefix_tables(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [len(ids_of("byte_bpe_50k.json", t[:n])) for n in range(len(t) + 1)]
        table = token_counts.PrefixTable(t)
        assert got[i] == want == [table.count(n) for n in range(len(t) + 1)]


def test_packing(docs, empty):
    pieces = packing.pack(docs).collect()
    assert sum(p["length"] for p in pieces) == sum(len(ids_of("byte_bpe_50k.json", t)) + 1 for _, t in corpus())
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    text = dict(corpus())
    for i in set(text) - {8}:  # 8 comes twice
        ids = np.array([*ids_of("byte_bpe_50k.json", text[i]), 1], "<u4")
        mine = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == i)
        assert [c for *_, c in mine] == [zlib.crc32(ids[s : s + n].tobytes()) for s, n, _ in mine] and sum(n for _, n, _ in mine) == len(ids)
        assert [s for s, _, _ in mine] == [sum(n for _, n, _ in mine[:k]) for k in range(len(mine))]
        assert {p["doc_tokens"] for p in pieces if p["doc_id"] == i} == {len(ids)}
    assert packing.pack(empty).count() == 0


def test_ranges_of_equal_bytes(spark):
    weight = np.array([0.0, 10, 500, 10, 10, 0, 20, 450])
    first, spread = packing.ranges(weight, 10)
    load = np.zeros(10)
    for w, f, m in zip(weight, first, spread, strict=True):
        assert f + m <= 10
        load[f : f + m] += w / m
    assert load.max() <= 3 * weight.sum() / 10 and (np.diff(first) >= 0).all()
    # copies of one text have one key; they are dealt by id
    rows = spark.createDataFrame([(i, "a few words " * 200) for i in range(300)] + [(1000, "x y " * 100_000)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in packing.along_curve(rows, 6).collect()) == [*range(300), 1000]
    sizes = [len(x) for x in packing.along_curve(rows.limit(300), 6).rdd.glom().collect()]
    assert sum(sizes) == 300 and max(sizes) < 100


def test_hilbert_neighbours():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    path = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_token_store(spark, docs, empty):
    scratch = Scratch(spark, "t")
    folder, _ = token_store.write_store(docs, scratch)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(spark, folder).collect())
    all_ids = {(i, zlib.crc32(np.array([*ids_of("word_bpe_49k.json", t), 2], "<u4").tobytes()), len(ids_of("word_bpe_49k.json", t)) + 1) for i, t in corpus()}
    assert {(d, c, n) for _, d, n, c in got} == all_ids and len(got) == len(corpus())
    assert [d for _, d, _, _ in got] == sorted(i for i, _ in corpus())
    at = 0
    for s, _, n, _ in got:
        assert s == at
        at += n
    chunks = token_store._parts(spark, folder, "chunk")
    assert chunks.count() == chunks.select("digest").distinct().count()
    folder, _ = token_store.write_store(empty, Scratch(spark, "t"))
    assert token_store.read_store(spark, folder).count() == 0


def test_store_refuses_a_lost_or_altered_recipe(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 4)  # several levels
    rows = spark.createDataFrame([(i, "text %d of some words" % i) for i in range(70)], "doc_id long, text string")
    folder, recipes = token_store.write_store(rows, Scratch(spark, "t"))
    levels = token_store.read_manifest(spark, folder)
    assert [levels.filter(f"level = {k}").count() for k in (1, 2, 3, 4, 5)] == [18, 5, 2, 1, 0]
    assert token_store.check_manifest(spark, folder)[0] == 70
    for k, broken in enumerate((recipes.filter("doc_id <> 33"), recipes.withColumn("doc_id", F.when(F.col("doc_id") == 5, 6).otherwise(F.col("doc_id"))), recipes.filter("doc_id < 64"))):
        other = f"{folder}-{k}"
        broken.write.parquet(f"{other}/recipes")
        levels.write.parquet(f"{other}/manifest")
        with pytest.raises(ValueError, match="differ from the manifest"):
            token_store.check_manifest(spark, other)


def test_fingerprints(docs, empty):
    order = sorted(((i, t or "") for i, t in corpus()), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        c = fingerprints.canonical
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(c(t) == c(e)), float(c(t) == c(after))))
    got = fingerprints.fingerprints(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == sorted(want)
    assert fingerprints.fingerprints(empty).count() == 0


def test_language(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    rows = language_id.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(docs).collect()}
    assert got[0] == got[1] == got[2] == got[7] == "und" and got[3] != "und"
    assert language_id.language_id(empty).count() == 0


def plain_bins(text):
    """Bins of a text's grams, in a list for each word."""
    flat = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c < 91 else 48 if 48 <= c < 58 else c for c in text.encode())
    out, side = [], b" " + flat + b" "
    for i, c in enumerate(flat):
        if c != 32:
            if side[i] == 32:
                out.append([])
            out[-1].append(((side[i] << 16 | c << 8 | side[i + 2]) * 2654435761 % 2**32) >> 16)
    return out


def test_language_against_plain(spark, monkeypatch):
    monkeypatch.setattr(language_id, "GROUP", 2)  # counts are added in a tree of several levels
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").repartition(7)
    rows = table.collect()
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    train = [r for r in rows if r["doc_id"] not in held and r["lang"] is not None and r["text"] is not None]
    counts = defaultdict(lambda: np.zeros(language_id.BINS))
    for r in train:
        for word in plain_bins(r["text"]):
            np.add.at(counts[r["lang"]], word, 1)
    langs = sorted(counts)
    want = np.array([np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * language_id.BINS)) for x in langs])
    got_langs, logp = language_id.learn(table.filter("lang is not null and text is not null").filter(~language_id.held_out("doc_id")))
    assert got_langs == langs and np.allclose(logp, want, atol=1e-4)
    got = {r["doc_id"]: r for r in language_id.language_id(table).collect()}
    assert len(got) == len(rows)
    for r in rows:
        answer = got[r["doc_id"]]
        assert answer["held_out"] == (r["doc_id"] in held)
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (answer["lang_pred"], answer["score"]) == ("und", 0)
            continue
        like = np.array([[sum(logp[x][g] for g in word) for word in plain_bins(r["text"])] for x in range(len(langs))])
        p = np.exp(np.maximum(like - like.max(axis=0), -language_id.CAP))
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(language_id.ITERATIONS):
            share = (p * share[:, None] / (p * share[:, None]).sum(axis=0)).mean(axis=1)
        assert answer["lang_pred"] in [langs[x] for x in np.flatnonzero(share > share.max() - 1e-3)] and abs(answer["score"] - share.max()) < 1e-3


def test_mixture_finds_both():
    like = np.array([[0.0] * 6 + [-20.0] * 4, [-20.0] * 6 + [0.0] * 4, [-20.0] * 10])
    pi, size, order = language_id.mixture(like, np.array([0]))
    assert abs(pi[0, 0] - 0.6) < 1e-3 and size[0] == 2 and order[0, 0] == 0


@pytest.mark.parametrize("module,query", [(license_scan, license_scan.op2_license_scan), (chat_format, chat_format.op5_chat_format)])
def test_against_sql(spark, module, query):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    want = con.execute(module.ORACLE)
    names = [x[0] for x in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_license_rules(spark, empty, tmp_path):
    bsd2 = "Copyright (c) 2020, A. Name\nAll rights reserved.\n\n" + BSD_CLAUSES
    bsd3 = bsd2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    gpl2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.
"""
    cases = [
        ("The MIT License (MIT)\n", "MIT"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nfoo. Licensed under CC BY 4.0.", "CC-BY-4.0"),
        (None, ""), ("", ""), (bsd2, "BSD-2-Clause"), (bsd3, "BSD-3-Clause"), (bsd3 + "\n\n" + bsd3, "BSD-3-Clause"), (bsd3 + "\n\n" + bsd2, "BSD-2-Clause AND BSD-3-Clause"),
        (gpl2, "GPL-2.0-or-later"), ("(c) X. All rights reserved.", "LicenseRef-proprietary"), ("All rights reserved.\nLicensed under the MIT license.", "MIT"), ("# " + bsd3.replace("\n", "\n# "), "BSD-3-Clause"),
    ]
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, (t, _) in enumerate(cases)] + [(4, bsd2, "clash", 1)], "doc_id long, text string, licenses string, n_known int")
    got = license_scan.license_scan(rows).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == [want for _, want in cases[:4]] + ["BSD-2-Clause"] + [want for _, want in cases[4:]]
    assert license_scan.license_scan(empty).count() == 0
    rows.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    names = ["doc_id", "n_sentences", "n_known", "sentence_ids", "licenses"]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({license_scan.ORACLE})").fetchall())


def test_wrapped_licenses(spark, tmp_path):
    known = license_scan.SENTENCES
    mit = """Copyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:\n
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.\n
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
    gpl = """/*\r\n * This program is free software: you can redistribute it and/or modify\r\n * it under the terms of the GNU General Public License as published by\r
 * the Free Software Foundation, either version 3 of the License, or\r\n * (at your option) any later version.\r\n *\r
 * This program is distributed in the hope that it will be useful,\r\n * but WITHOUT ANY WARRANTY; without even\r\n */"""
    apache = """# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#
#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and\n# limitations under the License."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:\n
1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n
2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.\n"""
    isc = "x\n" + known["isc_grant"].replace(" for any", "\nfor any") + "\nLicensed under the\nMIT license\nfoo"
    texts = [mit, gpl, apache, bsd, isc, "licensed under the\n\nMIT license", "licensed under the.\nMIT license", "a licensed under the\nMIT license", "licensed under the\x01MIT license" + "\n" * 50_000]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = license_scan.license_scan(rows).orderBy("doc_id").collect()
    rows.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert [(r["doc_id"], r["n_sentences"], r["n_known"], r["sentence_ids"], r["licenses"]) for r in got] == con.execute(f"{license_scan.ORACLE} ORDER BY doc_id").fetchall()
    assert [r["licenses"] for r in got] == ["MIT", "GPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "ISC AND MIT", "", "", "", "MIT"]
    assert got[1]["sentence_ids"] == "gpl_free>gpl3_redistribute>gpl_hope"


def test_chat_parts(spark):
    parts = [("text", "see [INST] <|end|> %3C", None, None), ("image", None, "i.png", 2), ("document", None, "d.pdf", 3)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None), (None, 0, "assistant", [("text", "x", None, None)])], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    made = chat_format.format_chat(rows)
    first = made.filter("conv_id = 1").first()
    assert [(a["type"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "i.png", 512), ("document", "d.pdf", 1536)]
    back = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert back[1]["turns_sha256"] == hashlib.sha256(b"user\nsee [INST] <|end|> %3C\n\n\n").hexdigest() and back[1]["n_turns"] == 2
    assert back[None]["loss_chars"] == 1


def test_chat_mask_and_edges(spark):
    long = "Ab [x] <y> 100% é " * 60_000
    rows = [(1, 0, "user", "hi", "c"), (1, 1, "assistant", "a%b[", "c"), (1, 1, "assistant", "a%b[", "c"), (1, None, None, None, None), (2, 5, "assistant", "", "c"), (3, 0, "assistant", long, "c"), (3, 1, "<|turn|>", "<|text|>x<|end|>", "c"), (None, 2, "assistant", "n", "c")]
    schema = "conv_id long, turn long, role string, text string, formatted string"
    made = chat_format.format_chat(chat_format.text_parts(spark.createDataFrame(rows, schema)))
    groups = defaultdict(list)
    for c, t, r, x, _ in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    for r in made.collect():
        at, covered = 0, []
        for m in r["loss_mask"]:
            covered.append(r["formatted"][at + m["before"] : at + m["before"] + m["under"]])
            at += m["before"] + m["under"] + m["after"]
        assert at == len(r["formatted"])
        plain = "".join(covered).replace("%5B", "[").replace("%3C", "<").replace("%25", "%")
        assert plain == "".join(x for _, _, role, x in sorted(groups[r["conv_id"]]) if role == "assistant")
    back = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert back.keys() == groups.keys()
    for c, turns in groups.items():
        turns = sorted(turns)
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        assert back[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in turns).encode()).hexdigest()
        assert (back[c]["n_turns"], back[c]["loss_chars"], back[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nothing = spark.createDataFrame([], schema)
    assert chat_format.read_back(chat_format.format_chat(chat_format.text_parts(nothing))).count() == 0


def test_leaks(spark, empty):
    sf = "/root/testdata/sf0.01"
    docs, bench = (duckdb.sql(f"SELECT * FROM '{sf}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    exact = {(d[0], b[0]) for b in bench for d in docs if b[1] in d[1]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op10_benchmark_leaks(spark, sf).collect()}
    assert got >= exact and len(got - exact) <= 0.05 * len(exact)
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert decontaminate.benchmark_leaks(empty, items).count() == 0


def told(rng, n):
    return " ".join("u%d" % rng.randrange(10**7) for _ in range(n))


def found_leaks(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.benchmark_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_leaks_of_a_common_passage(spark):
    rng = random.Random(3)
    often, rare, plain = told(rng, 20), told(rng, 20), "to be or not to be that is the question we have to answer"
    words = plain.split()
    docs = [(i, f"{told(rng, 30)} {' '.join(rng.sample(words, 8))} {often if i % 3 == 0 else ''} {plain if i % 20 == 1 else ''} {told(rng, 30)}") for i in range(120)]
    docs.append((500, f"{told(rng, 90)} {rare} {told(rng, 40)}"))
    got = found_leaks(spark, docs, [(1, often), (2, rare), (3, plain)])
    assert {d for d, i in got if i == 1} == {*range(0, 120, 3)} and {d for d, i in got if i == 2} == {500}
    assert {d for d, i in got if i == 3} >= {*range(1, 120, 20)}


def test_leaks_of_each_benchmark_row(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    rng = random.Random(4)
    items = [(k, told(rng, 25)) for k in [None, None, None, None, 1, 7, 7, 7, 7, 7, 8]]
    items += [items[5], (9, None), (9, "")]
    docs = [(i, f"{told(rng, 40)} {t} {told(rng, 40)}") for i, (_, t) in enumerate(items[:11])]
    assert found_leaks(spark, docs, items) == {(i, k) for i, (k, _) in enumerate(items[:11])}


def test_leaks_of_long_items(spark):
    rng = random.Random(5)
    items = [(i, told(rng, n)) for i, n in enumerate((90, 97, 600, 1500, 97, 600, 1500))]
    docs = [(i, f"{told(rng, 100 + i)} {t} {told(rng, 50)}") for i, t in items[:4]]
    altered = [" ".join(told(rng, 1) if k % 7 == 6 else w for k, w in enumerate(t.split())) for _, t in items[4:]]
    docs += [(i, f"{told(rng, 70)} {t} {told(rng, 50)}") for i, t in enumerate(altered, 4)]
    lost = [w for _, t in items[4:] for w in t.split()[6::7]]  # elsewhere they are common, so that they aren't the answers
    docs += [(30 + i, " ".join(rng.sample(lost, len(lost)))) for i in range(4)]
    docs += [(20, " ".join(items[3][1].split()[:700]) + " " + told(rng, 700)), (21, told(rng, 2000))]
    assert found_leaks(spark, docs, items) == {(i, i) for i in range(7)}


def test_leaks_of_short_items(spark):
    rng = random.Random(6)
    items = [(1, "alpha beta gamma"), (2, "the quick brown fox"), (3, "Yes"), (4, "one two three four five six seven"), (5, "to be or not")]
    docs = [(i, f"{told(rng, 60)} {t} {told(rng, 60)}") for i, t in items if i != 3]
    docs += [(10, "yes."), (11, f"yes {told(rng, 9)}"), (12, f"{told(rng, 20)} alpha beta {told(rng, 5)} gamma"), (13, "alpha BETA, gamma"), (14, "alpha beta"), (15, None), (16, "")]
    docs += [(100 + i, f"to be {told(rng, 30)} or not {told(rng, 30)}") for i in range(50)]
    assert found_leaks(spark, docs, items) == {(1, 1), (2, 2), (4, 4), (5, 5), (10, 3), (13, 1)}


def paraphrased(rng, text, words):
    """A text with 15 % of its words replaced and 7 % left out."""
    out = []
    for w in text.split():
        u = rng.random()
        out += [rng.choice(words)] if u < 0.15 else [] if u < 0.22 else [w]
    return " ".join(out)


def test_leaks_of_paraphrases(spark, capsys):
    sf = "/root/testdata/sf0.01"
    docs, bench = (duckdb.sql(f"SELECT * FROM '{sf}/{t}.parquet' WHERE text IS NOT NULL ORDER BY 1").fetchall() for t in ("documents", "benchmark"))
    rng = random.Random(8)
    hosts = [d[1] for d in docs if not any(b[1] in d[1] for b in bench)]
    words = " ".join(hosts).split()
    planted = []
    for k, (i, t) in enumerate(bench * 5):
        host = rng.choice(hosts).split()
        at = rng.randrange(len(host) + 1)
        planted.append((10**6 + k, " ".join([*host[:at], paraphrased(rng, t, words), *host[at:]]), i))
    got = found_leaks(spark, [(d[0], d[1]) for d in docs] + [p[:2] for p in planted], bench)
    recall = sum((d, i) in got for d, _, i in planted) / len(planted)
    with capsys.disabled():
        print(f" recall of {len(planted)} paraphrases: {recall:.3f}", end="")
    assert recall >= 0.9


def test_leaks_come_through_the_space(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, told(rng, 30)) for i in range(40)]
    docs = [(i, f"{told(rng, 30)} {t} {told(rng, 30)}") for i, t in items] + [(100 + i, " ".join(rng.sample(" ".join(t for _, t in items).split(), 60))) for i in range(60)]
    want = {(i, i) for i in range(40)}
    assert found_leaks(spark, docs, items) >= want
    tried = []
    monkeypatch.setattr(decontaminate, "latent_space", lambda d, items, *_: tried.append(1) or np.zeros((len(items.vocab), 1), np.float32))
    assert tried == [] and not found_leaks(spark, docs, items) and tried == [1]


def test_common_subsequence():
    assert decontaminate.common_subsequence(np.array([1, 2, 3, 4]), [9, 1, 3, 9, 4]) == 3


def test_pipeline_keeps_clean_documents(spark, docs, empty, tmp_path):
    stage = dict(stages.STAGES)
    kept = stage["language ID"](spark, docs, "")
    assert kept.columns == stages.COLUMNS and {r["doc_id"] for r in kept.collect()} == {i for i, t in corpus() if t and re.search("[a-z]|é|日", t)}
    one = stage["n-gram Jaccard join"](spark, kept, "")
    assert 0 < one.count() < kept.count()
    assert stage["suffix-array dedup"](spark, one, "").filter("trim(text) = ''").count() == 0
    item = dict(corpus())[70]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.createDataFrame([(r["doc_id"], r["text"], "x") for r in docs.collect()], "doc_id long, text string, uid string")  # no lang, and a clash
    clean = {r["doc_id"] for r in stage["benchmark decontamination"](spark, rows, str(tmp_path)).collect()}
    assert clean == {i for i, t in corpus() if not t or item not in t}
    for name, f in stages.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline_is_its_stages_in_order(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, dict(corpus())[70])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = docs
    for _, f in stages.STAGES:
        want = f(spark, want, str(tmp_path))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = lambda df: sorted({(r["doc_id"], r["doc_tokens"]) for r in df.select(*names).collect()})
    assert whole(stages.run(spark, str(tmp_path))) == whole(want) != []
