"""Top-k search, quality classifier, decontamination, licence and secret scans."""

import hashlib
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import decontaminate, licences, quality, queries, secrets, topk
from inkwell.llm.common import table


def brute_topk(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, big = set(), 2**63 - 1
    held = lambda s: max(-big - 1, min(big, s))
    for q in sorted({i for i, _ in ok if i % every == 0}):
        qv = min(v for i, v in ok if i == q)
        best = sorted((-held(sum(a * b for a, b in zip(qv, v))), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' AS v", "1 AS score", "2 AS rank").repartition(3)


def test_topk_fixture(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, sf_dir, "embeddings").collect()]
    assert set(map(tuple, queries.op2_topk_search(spark, sf_dir).collect())) == brute_topk(rows)


def scored(ids, x, every=50, tile=1000):
    """The share of pairs that are scored exactly, with the rows a tile at a time."""
    is_query = ids % every == 0
    best = topk.Best(int(is_query.sum()), 5)
    stats = [topk.statistics(x[is_query], p) for p in topk.levels(x.shape[1])]
    for at in range(0, len(x), tile):
        topk._compare(best, ids[is_query], x[is_query], stats, ids[at : at + tile], x[at : at + tile])
    return best.scored / (is_query.sum() * len(x))


def test_topk_prunes():
    """Segments rule out over half of the pairs even of random directions, which have no structure, and nearly all of smooth vectors."""
    rng = np.random.default_rng(1)
    ids = np.arange(4000)
    x = rng.normal(size=(4000, 64))
    assert scored(ids, np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])) < 0.5
    smooth = rng.normal(size=(4000, 64)).cumsum(1)
    assert scored(ids, np.floor(256 * smooth)) < 0.02


def test_topk_prunes_fixture(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no table here")
    rows = topk.whole_vectors(table(spark, path, "embeddings")).collect()
    assert scored(np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])) < 0.5


def test_topk_edges(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(9)]) for i in range(120)]
    rows += [(150, None), (200, [None] * 9), (250, [float("nan")] * 9), (300, [float("inf")] * 9), (None, [1.0] * 9), (350, [1.0, 2.0]), (351, [2.0, 2.0]), (400, []), (401, []), (450, [3e30, 3e30]), (451, [-3e30, 3e30])]
    want = brute_topk(rows)
    assert set(map(tuple, topk.search(vectors_of(spark, rows)).collect())) == want
    monkeypatch.setattr(topk, "PASS_BYTES", 100)  # every query in a pass of its own
    assert set(map(tuple, topk.search(vectors_of(spark, rows)).collect())) == want
    assert topk.search(vectors_of(spark, [])).collect() == []
    assert topk.search(vectors_of(spark, [(1, [1.0])])).collect() == []
    assert topk.search(vectors_of(spark, [(50, [1.0])])).collect() == []
    twice = [(50, [1.0]), (50, [1.0]), (1, [2.0]), (1, [2.0])]
    assert sorted(map(tuple, topk.search(vectors_of(spark, twice)).collect())) == [(50, 1, 1, 256 * 512), (50, 2, 1, 256 * 512)]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 20), st.integers(0, 10**6))
def test_bounds_hold(parts, seed):
    rng = np.random.default_rng(seed)
    q, x = rng.integers(-300, 300, (3, 20)).astype(float), rng.integers(-300, 300, (5, 20)).astype(float)
    assert (topk.statistics(q, parts) @ topk.statistics(x, parts).T + 1e-3 >= q @ x.T).all()


def test_quality_contract(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    again = {r.doc_id: r.score for r in quality.score_documents(docs.repartition(5), labels.repartition(2)).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-12)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert {r.doc_id: r.score for r in quality.score_documents(docs, other).collect()} == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-12)


def test_quality_held_out_accuracy(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    d = "/root/testdata/sf0.01"
    rows = queries.op4_quality_classifier(spark, d).where("held_out").join(table(spark, d, "labels"), "doc_id").where("quality is not null").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert sum(r.predicted for r in rows if r.quality == 1) == sum(r.quality for r in rows)


def test_quality_edges(spark, docs_of):
    rows = [(1, None), (None, "a"), (2, ""), (3, "x " * 100_000), (4, "dup"), (4, "dup")]
    docs = docs_of(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score_documents(docs, none).collect()] == [0.5] * 6
    one = spark.createDataFrame([(3, 1, None), (None, 0, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, one).collect()
    assert len(got) == 6 and all(r.score > 0.99 for r in got) and {r.held_out for r in got if r.doc_id is None} == {True}
    assert quality.keep_good(docs, one).count() == 6 and quality.keep_good(docs, one).columns == docs.columns
    assert quality.score_documents(docs_of([]), one).collect() == []


def test_boosting_learns_shapes_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    for y in (np.abs(x[:, 0] - 0.5) < 0.2, (x[:, 1] > 0.5) != (x[:, 2] > 0.5)):
        model = quality.fit(x[:2000], y[:2000].astype(float))
        assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.93
    one = quality.tree_1d(np.array([3.0, 3.0, -5.0, 1.0]), np.ones(4), 3)
    assert one[0] == one[1] > 0 > one[2]


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion of great power near the old stone bridge"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def distance_within(pattern, text):
    """Least edit distance of pattern to any part of text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", max_size=30))
def test_myers(pattern, text):
    got = decontaminate.myers(decontaminate.masks_of(pattern), len(pattern), text, len(pattern))
    want = distance_within(pattern, text)
    assert (got[0] if got else len(pattern)) == want


def damaged(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:i] + (rng.choice("xyz") if kind < 2 else "") + text[i + (kind != 1) :]
    return text


def test_decontamination_finds_every_edit_within_budget(spark, docs_of):
    rng = random.Random(3)
    items = [(1, ITEM), (2, ITEM.upper().replace(" ", "\n ")), (3, "too short"), (4, None), (5, ""), (None, "an item without an id that has words enough")]
    filler = lambda: " ".join(rng.choice(["zeta", "rho", "kappa", "tau"]) for _ in range(60))
    rows = [(i, filler() + " " + damaged(rng, ITEM, i % 9) + " " + filler()) for i in range(60)]
    rows += [(100, None), (101, ""), (102, filler() * 400), (103, ITEM), (103, ITEM), (None, ITEM[:-1]), (104, ITEM[: len(ITEM) // 2]), (105, filler() * 300 + ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS start")
    docs = docs_of(rows)
    k = int(len(ITEM) * decontaminate.RATE)
    plain = decontaminate.plain(ITEM)
    want = sorted(str((d, i)) for d, t in rows for i in (1, 2) if distance_within(plain, decontaminate.plain(t)) <= k)
    hits = decontaminate.find_hits(docs, bench).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in hits) == want
    text_of = {d: decontaminate.plain(t) for d, t in rows}
    for r in hits:
        assert r.distance == distance_within(plain, text_of[r.doc_id]) == distance(text_of[r.doc_id][r.start : r.end], plain)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in rows if distance_within(plain, decontaminate.plain(t)) > k)


def test_decontamination_in_blocks_and_empty(spark, docs_of, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number {i} has these words of its own {i * 7919}") for i in range(6)], "item_id long, text string")
    docs = docs_of([(i, f"before item number {i} has these words of its own {i * 7919} after") for i in range(8)])
    whole = sorted(map(tuple, decontaminate.find_hits(docs, bench, 0.0).collect()))
    assert {r[0] for r in whole} == set(range(6))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert sorted(map(tuple, decontaminate.find_hits(docs, bench, 0.0).collect())) == whole
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench, 0.0).collect()) == [6, 7]
    none = bench.limit(0)
    assert decontaminate.find_hits(docs, none).collect() == [] and decontaminate.drop_contaminated(docs, none).count() == 8
    assert decontaminate.find_hits(docs_of([]), bench).collect() == []


def test_licences(spark, docs_of):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "x\nReleased under the MIT License."), (2, mit), (3, mit.replace("\n\n", "\nSomething else.\n")), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0. More text"), (7, "LICENSED under the  Apache License, Version 2.0!"), (None, "All rights reserved."), (8, "All rights reserved.\nAll rights reserved"), (8, "All rights reserved.\nAll rights reserved"), (9, "the MIT License"), (10, "a. " * 50_000 + "\nReleased under the MIT License.")]
    got = sorted((str(r.doc_id), r.licence, r.sentence, r.n_sentences) for r in licences.scan_documents(docs_of(rows)).collect())
    assert got == sorted([("1", "MIT", 1, 1), ("2", "MIT", 0, 2), ("6", "CC-BY-NC-4.0", 0, 1), ("7", "Apache-2.0", 0, 1), ("None", "All-rights-reserved", 0, 1), *[("8", "All-rights-reserved", n, 1) for n in (0, 1)] * 2, ("10", "MIT", 50_000, 1)])
    assert licences.scan_documents(docs_of([])).collect() == []


def test_decontamination_by_items_of_few_words(spark, docs_of):
    han, thai = "敏捷的棕色狐狸跳过了那只懒惰的狗然后回到森林里的家", "สุนัขจิ้งจอกสีน้ำตาลกระโดดข้ามสุนัขขี้เกียจ"
    items = [(1, han), (2, thai), (3, "Self.weights @ inputs.transpose"), (4, "E=mc²"), (5, "狐狸"), (6, " "), (7, None)]
    rows = [(1, f"前文{han}后文"), (2, f"x {thai}."), (3, "y = (self.weights  @ inputs.transpose)"), (4, "so e=mc² holds"), (5, "the=mc² e=mc²x"), (6, "self.weights @ inputs.transposed"), (7, f"前文{han[:9]}鱼{han[10:]}后文"), (8, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.find_hits(docs_of(rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in hits) == [(1, 1, 0), (1, 5, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (7, 1, 1), (7, 5, 0)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs_of(rows), bench).collect()) == [5, 6, 8]


def wrapped_at(text, width):
    return "\n".join(textwrap.fill(part, width) for part in text.split("\n"))


NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
}
NOTICES["BSD-3-Clause"] = NOTICES["BSD-2-Clause"] + "\n3) Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def instance(wording, rng):
    """One text that a wording stands for."""
    pick = lambda m: rng.choice(m[1].split("|"))
    wording = re.sub(r"\[([^\]]*)\]", lambda m: pick(m) if rng.random() < 0.5 else "", wording)
    wording = re.sub(r"\{([^}]*)\}", pick, wording)
    return " ".join(re.sub(r"\*(\d+)", lambda m: " ".join(rng.choices(["jane", "doe", "acme", "corp", "2020"], k=rng.randrange(1, min(5, int(m[1]) + 1)))), wording).split())


DRESSES = [("", ""), ("# ", ""), (" * ", ""), ("// ", ""), (";; ", ""), ("-- ", " --"), ("<!-- ", " -->")]


def dressed(sentences, rng):
    """Sentences as they stand in files: with or without list numbers, in either case, wrapped, and in comments."""
    text = " ".join((rng.choice([f"{n + 1}. ", f"({n + 1}) ", ""]) if n else "") + s.capitalize() + rng.choice([".", ":", ";"]) for n, s in enumerate(sentences))
    text = text.upper() if rng.random() < 0.2 else text
    before, after = rng.choice(DRESSES)
    return "\n".join(before + line + after for line in wrapped_at(text, rng.choice([40, 60, 72, 80, 9999])).split("\n"))


def test_licence_recall(spark, docs_of):
    """Every rule's notice is found in every dress, and no other licence in it."""
    rng = random.Random(8)
    rows, want = [], {}
    for licence, needs in licences.RULES:
        for _ in range(4):
            chosen = [n.rstrip("?") for n in needs if not n.endswith("?") or rng.random() < 0.6]
            want[len(rows)] = licence
            rows.append((len(rows), "Some header line.\n\n" + dressed([instance(rng.choice(licences.SENTENCES[n]), rng) for n in chosen], rng) + "\n\nint main() {}"))
    found = {}
    for r in licences.scan_documents(docs_of(rows)).collect():
        found.setdefault(r.doc_id, set()).add(r.licence)
    wrong = [(want[i], found.get(i), rows[i][1]) for i in want if found.get(i) != {want[i]}]
    print(len(wrong), wrong[:3])
    assert len(wrong) <= 0.02 * len(rows)


EXPRESSED = [
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache-2.0"}), ("# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", {"GPL-2.0-or-later"}),
    ("/* SPDX-License-Identifier: (BSD-3-Clause AND MIT) */", {"BSD-3-Clause", "MIT"}), ("SPDX-License-Identifier:0BSD", {"0BSD"}), ("SPDX-License-Identifier: Nothing-1.0", set()), ("spdx license identifiers are short", set()),
]


def test_licences_of_standard_notices(spark, docs_of):
    notices = [(name, text) for name, text in sorted(NOTICES.items())]
    notices = [(name, "A header line.\n\n" + wrapped_at(text, width)) for name, text in notices for width in (9999, 78, 40)]
    got = licences.scan_documents(docs_of(list(enumerate(t for _, t in notices)))).collect()
    assert sorted({(r.doc_id, r.licence, r.sentence) for r in got}) == [(i, name, 1) for i, (name, _) in enumerate(notices)]
    got = licences.scan_documents(docs_of([(i, t) for i, (t, _) in enumerate(EXPRESSED)])).collect()
    assert {i: {r.licence for r in got if r.doc_id == i} for i in range(len(EXPRESSED))} == {i: s for i, (_, s) in enumerate(EXPRESSED)}
    torn = [(0, "Not released under\nthe MIT License."), (1, "Released under the MIT License or\nanother."), (2, NOTICES["ISC"].replace("fee is", "fee\nnever is")), (3, NOTICES["BSD-2-Clause"].replace("1. ", "1. Perhaps. "))]
    assert licences.scan_documents(docs_of(torn)).collect() == []
    twice = licences.scan_documents(docs_of([(1, "All rights\nreserved.\nAll rights reserved. Other.\nAll\nrights\nreserved")])).collect()
    assert sorted((r.sentence, r.n_sentences) for r in twice) == [(0, 2), (2, 1), (4, 3)]


def test_licences_oracle_holds_wrapped_notices(spark, docs_of):
    """The SQL twin agrees on notices, expressions and torn texts too, not only on the tables' single lines."""
    import duckdb

    rng = random.Random(9)
    texts = [wrapped_at(t, w) for t in NOTICES.values() for w in (9999, 60)] + [t for t, _ in EXPRESSED] + ["", "a. b", "Released under the MIT License. All rights reserved. 1. Licensed under CC BY-SA 4.0."]
    texts += [dressed([instance(rng.choice(licences.SENTENCES[n.rstrip("?")]), rng) for n in needs], rng) for _, needs in licences.RULES]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = c.execute(queries.ORACLES["op7_licence_scans"]).fetchall()
    assert sorted(map(tuple, licences.scan_documents(docs_of(list(enumerate(texts)))).collect())) == sorted(want) and len(want) > 80


def test_licences_oracle(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(queries.ORACLES["op7_licence_scans"]).fetchall()
    assert sorted(map(tuple, queries.op7_licence_scans(spark, sf_dir).collect())) == sorted(want)


BASE = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32))


def plain_spans(text):
    """The base spans straight from their definition."""
    found = [(m.start(), n, k, m.end()) for n, (k, rx, ok) in enumerate(BASE) for m in rx.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


PIECES = ["password", "PassWD", "secret", "token", "api_key", "apikey", "API_KEY", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH1234567", "deadbeef" * 4, "0f" * 20, "é", "İ", "K", "ſecret", "abcdefgh", "-", "x", "\n", "tokensecret", "_", "/", "12345678"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_secret_spans(parts):
    text = "".join(parts)
    assert [f"{k}:{s}:{e}" for k, s, e in secrets.find(text) if k in ("assign", "access", "hex")] == plain_spans(text)


def test_secret_scan(spark, docs_of):
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = f"ghp_{body}{secrets.checksum(body)}"
    rows = [(1, f"x {good} y"), (2, f"x ghp_{body}000000 y"), (3, f"npm_{body}{secrets.checksum(body)}"), (4, None), (5, ""), (None, "token=abcdefgh"), (6, "token=abcdefgh"), (6, "token=abcdefgh"), (7, "é" * 200_000 + "password: 'hunter2hunter2'"), (8, "token=short")]
    got = secrets.scan_documents(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.spans): r for r in got}
    assert (1, "github:2:42") in by and (2, "") in by and (3, "npm:0:40") in by and (8, "") in by
    for d, t in rows:
        r = next(r for r in got if r.doc_id == d)
        base = plain_spans(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert secrets.scan_documents(docs_of([])).collect() == []


def test_secret_scan_fixture(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in queries.op8_secret_scans(spark, sf_dir).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(plain_spans(texts[r.doc_id])).encode()).hexdigest()
