"""Operators on small tables: edge cases, and brute force where SQL can't say it."""

import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import binary_ids, common, components, html_text, langid, licences, media, mixing, near_dedup, passages
from specloom.session import ready

VOCAB = [f"w{i}" for i in range(4000)]


def docs(spark, rows, extra=""):
    return ready(spark).createDataFrame(rows, "doc_id long, text string" + extra)


def words(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_token_files(spark, tmp_path):
    rows = [(5, "a b c"), (-1, None), (7, ""), (6, "x  y\n z"), (5, "other")]
    path = str(tmp_path / "ids")
    binary_ids.write(docs(spark, rows), path)
    found = binary_ids.read(spark, path).join(binary_ids.starts(spark, path), "at").orderBy("before", "place").collect()
    assert [r["doc_id"] for r in found] == [-1, 5, 5, 6, 7]
    assert found[0]["n_tokens"] == 1 and found[-1]["n_tokens"] == 1
    at = 0
    for r in found:
        assert r["before"] + r["place"] == at
        at += r["n_tokens"]
    one = binary_ids.access(spark, path, spark.createDataFrame([(6, 0), (6, 99), (8, 0)], "doc_id long, place long")).collect()
    ids = {(r["doc_id"], r["place"]): r["id"] for r in one}
    first = int.from_bytes(next(bytes(r["ids"]) for r in found if r["doc_id"] == 6)[:4], "little")
    assert ids == {(6, 0): first, (6, 99): None, (8, 0): None}


def test_media_round_trip(spark):
    for n in (0, 1, 64, 65, 70_000, 300_000):
        data = bytes(random.Random(n).randbytes(n))
        file = media.build(media.padded(data))
        assert media.read_payload(file) == media.padded(data)
        assert len(media.padded(data)) % 64 == 0 and media.padded(data)
        t = media.tracks(file)[0]
        ranges = media.key_ranges(t)
        assert ranges[0][0] == file.index(b"mdat") + 4 and all(a + n <= len(file) for a, n in ranges)
    broken = spark.createDataFrame([(1, bytearray(b"xx")), (2, None)], "doc_id long, media binary")
    assert [r["feature"] for r in media.probe_media(broken).collect()] == [None, None]


def test_mixing_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "abc"[i % 3] if i % 10 else None) for i in range(300)] + [(300, None, "d"), (301, "", "a")]
    df = ready(spark).createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
        assert all(0 <= p < 1 for p in r["positions"])
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(df.limit(0)).count() == 0
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got}
    assert {x for e in edges if e[0] != e[1] for x in e} == set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(rows, width, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    group = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {d: (len(sets[d]), group[d]) for d in sets}


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two"), (5, "two one")]
    for k in range(6):
        base = words(rng, 60)
        for v in range(5):
            w = list(base)
            for _ in range(v * 2):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rows.append((10 + 10 * k + v, " ".join(w)))
    rows.append((99, rows[8][1]))
    for k in range(40):  # pairs about the limit
        base = words(rng, 201)
        w = list(base)
        for at in rng.sample(range(0, 200, 4), 9 + k % 6):
            w[at] = f"other{k}"
        rows += [(200 + 2 * k, " ".join(base)), (201 + 2 * k, " ".join(w))]
    morse = "".join("ab"[k.bit_count() & 1] for k in range(2048))  # with its complement it collides under polynomial hashes
    rows += [(400, morse), (401, morse.translate(str.maketrans("ab", "ba"))), (402, morse.upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs(spark, rows)).collect()}
    assert got == brute_groups(rows, 2)


def test_passages(spark):
    rng = random.Random(9)
    passage = words(rng, 60)
    clean = [words(rng, 120) for _ in range(4)]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    rows += [(10, " ".join(words(rng, 30) + passage + words(rng, 40))), (11, "\n".join([" ".join(words(rng, 50)), " ".join(passage) + " " + " ".join(words(rng, 20))])), (12, None), (13, ""), (14, rows[0][1])]
    out = {r["doc_id"]: r for r in passages.dedup(docs(spark, [(*r, "x") for r in rows], ", changed string")).collect()}
    assert all(not out[i]["changed"] and out[i]["text"] == dict(rows)[i] for i in (0, 1, 2, 3, 10, 12, 13))
    assert out[11]["changed"] and 50 <= out[11]["n_removed"] <= 62
    assert " ".join(passage[8:52]) not in out[11]["text"]
    assert out[14]["text"].strip() == ""
    assert passages.dedup(docs(spark, rows).limit(0)).count() == 0


def test_passages_keep_what_does_not_repeat(spark):
    rng = random.Random(21)
    form = [words(rng, 14) for _ in range(8)]
    rows = [(i, " ".join(" ".join([*p, f"value{i}x{k}", f"more{i}x{k}", f"still{i}x{k}"]) for k, p in enumerate(form))) for i in range(3)]
    parts = [words(rng, 30) for _ in range(4)]
    rows += [(10 + i, " ".join(words(rng, 40) + p + words(rng, 40))) for i, p in enumerate(parts)]
    rows.append((20, " ".join(sum(parts, []))))
    near = words(rng, 200)
    rows += [(i, "\n".join(" ".join(w[k : k + 10]) for k in range(0, 200, 10))) for i, w in ((30, near), (31, [*near[:100], "unlike", *near[101:]]))]  # no line is long
    out = {r["doc_id"]: r for r in passages.dedup(docs(spark, rows)).collect()}
    assert all(not out[i]["changed"] for i in (0, 1, 2, 10, 11, 12, 13, 20, 30))  # common phrases, no common passage
    assert out[31]["text"].split() == ["unlike"] and out[31]["n_removed"] == 199


def test_passages_edges_are_exact(spark):
    rng = random.Random(22)
    passage = words(rng, 80)
    sides = [([f"a{i}x{k}" for k in range(30)], [f"b{i}x{k}" for k in range(30)]) for i in range(600)]
    rows = [(i, " ".join([*a, *passage, *b])) for i, (a, b) in enumerate(sides)]
    out = {r["doc_id"]: r["text"] for r in passages.dedup(docs(spark, rows)).collect()}
    assert out[0] == rows[0][1]
    assert all(out[i].split() == [*a, *b] for i, (a, b) in enumerate(sides) if i)


def test_language(spark):
    rng = random.Random(3)
    syll = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "ber", "ung"]}

    def text(lang):
        return " ".join("".join(rng.choice(syll[lang]) for _ in range(3)) for _ in range(20))

    rows = [(i, text("xx" if i % 2 else "yy"), ("xx" if i % 2 else "yy") if i % 9 else None) for i in range(120)] + [(200, None, "xx"), (201, "12 34", "xx"), (202, "", None)]
    df = ready(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id < 90"))
    out = {r["doc_id"]: r for r in langid.predict(df.select("doc_id", "text"), model).collect()}
    assert all(out[i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in range(90, 120))
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (200, 201, 202))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    none = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df.select("doc_id", "text"), none).collect()} == {"und"}


def test_language_model_sums_to_one():
    rng = random.Random(5)
    made = {x: [("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))), rng.randrange(1, 9)) for _ in range(200)] for x, letters in (("xx", "abcde"), ("yy", "defgh"))}
    model = langid.Model(["xx", "yy"], {x: sorted(dict(v).items()) for x, v in made.items()})
    for context in ("", "a", "de", "abc", "dede", "hgfed", "zz"):
        found = [context + c for c in "abcdefgh"] + [context, context + "\u4e00"]  # a letter, the end, and the unseen symbol
        codes, place, _ = langid.lay_out(found)
        p = np.exp(model.char_scores(codes, place)[place == len(context) + 1].astype(float))
        p = p[: len(found)] if len(p) == len(found) else p  # words that are longer have one character there each
        assert np.allclose(p.sum(0), 1, atol=1e-4), context


def test_language_without_spaces(spark):
    rng = random.Random(6)
    text = {"zh": lambda: "".join(rng.choice("\u4e2d\u6587\u5b57\u7684\u662f\u4e0d\u4e86\u4eba") for _ in range(300)), "en": lambda: " ".join(rng.choice(["the", "of", "and", "word"]) for _ in range(50))}
    rows = [(i, text["zh" if i % 2 else "en"](), "zh" if i % 2 else "en") for i in range(80)]
    df = ready(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id < 60"))
    assert model.langs == ["en", "zh"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df.select("doc_id", "text"), model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_media_deep_and_odd_boxes():
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    assert media.tracks(deep) == []
    sizes = [5, 0, 7, 11]
    stbl = media.box(b"stbl", media.full(b"stsd", 0, b"\0\0\0\1" + media.box(b"avc1")), media.full(b"stsz", 0, struct.pack(">6I", 0, 4, *sizes)), media.full(b"stsc", 0, struct.pack(">7I", 2, 1, 1, 1, 2, 3, 1)), media.full(b"co64", 0, struct.pack(">IQQ", 2, 1000, 5000)), media.full(b"stss", 0, struct.pack(">3I", 2, 1, 4)))
    trak = media.box(b"trak", media.box(b"edts", media.full(b"elst", 0, bytes(4))), media.box(b"mdia", media.full(b"mdhd", 0, struct.pack(">4I", 0, 0, 600, 1200), bytes(4)), media.full(b"hdlr", 0, bytes(4), b"vide"), media.box(b"minf", stbl)))
    found = media.tracks(media.box(b"moov", trak, trak))
    assert len(found) == 2 and found[0]["codec"] == "avc1" and found[0]["handler"] == "vide"
    assert media.chunk_ranges(found[0]) == [(0, 1, 1000), (1, 3, 5000)]
    assert media.key_ranges(found[1]) == [(1000, 5), (5007, 11)]


def test_stages_with_odd_tables(spark):
    """Every stage on an empty table and on one with nulls, repeated ids and rows, and columns named like its own."""
    import corpus_pipeline

    rng = random.Random(8)
    names = ["__gone", "__cut", "__codes", "__spans", "id", "key", "rest", "spans", "band", "codes", "n", "before", "pieces", "hot0", "size", "row", "at", "copy"]
    text = " ".join(words(rng, 80))
    rows = [(d, t, "en", s, 1) for d, t, s in ((1, text, "a"), (1, text, "a"), (1, " ".join(words(rng, 90)), None), (None, text, "b"), (4, None, "a"), (5, "", "a"), (6, text + " more", "b"), (7, " ".join(words(rng, 60)), "b"))]
    df = ready(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("x").alias(x) for x in names])
    for name, stage in corpus_pipeline.STAGES:
        for some in (df, df.limit(0)):
            out = stage(spark, some, "")
            found = out.collect()
            if some is not df:
                assert not found, name
            elif name == "byte_bpe":
                assert len(found) == len(rows) and set(names) <= set(out.columns)
            else:
                assert out.columns == df.columns, name
                kept = [r["doc_id"] for r in found]
                assert 7 in kept if name != "mixing" else True
                if name == "near_dedup":
                    assert sorted(kept, key=str) == sorted([1, 1, 1, None, 4, 5, 7], key=str)


def test_licences(spark):
    rows = [(1, "foo bar.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, "A fishing license costs ten dollars"), (4, None), (5, ""), (6, "nothing"), (7, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.")]
    df = docs(spark, rows)
    out = {r["doc_id"]: r for r in licences.scan(df, licences.train(spark, df.select("text"))).collect()}
    assert [out[i]["licence"] for i in range(1, 7)] == ["mit", "cc-by-nc", "unknown", "none", "none", "none"]
    assert sorted(out[7]["licences"]) == ["gpl", "proprietary"]


def test_licences_wrapped(spark):
    bsd = """Copyright (c) 2019, The authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer."""
    mit = """ * Permission is hereby
 * granted, free of charge,
 * to any person obtaining
 * a copy of this software
 * and associated
 * documentation files (the Software), to deal in the Software without
 * restriction, including without limitation the rights to use, copy, modify,
 * merge, publish, distribute, sublicense, and sell copies of the Software"""
    df = docs(spark, [(1, bsd), (2, mit), (3, bsd.split("\n\n")[1]), (4, " ".join(["word"] * 100) + " " + mit.replace("\n *", ""))])
    out = {r["doc_id"]: r["licences"] for r in licences.scan(df, licences.train(spark, df.select("text"))).collect()}
    assert "bsd" in out[1] and out[3] == ["bsd"] and out[2] == out[4] == ["mit"]


def test_licences_short_names(spark):
    said = {
        "mit": ["SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: MIT\nimport os"],
        "apache-2.0": ["// SPDX-License-Identifier: Apache-2.0", 'license = "Apache-2.0"'],
        "bsd": ['license = "BSD-3-Clause"'],
        "gpl": ["License: GPL-2.0-or-later", "Released under the GPLv3", "Distributed under the terms of the GNU General\nPublic License version 3"],
        "lgpl": ["Distributed under the terms of the GNU Lesser General Public License version 3"],
    }
    none = ["The license of the dog was lost", "a fishing permission was given to the officer", "plain words only"]
    rows = [(x, k) for k, v in said.items() for x in v] + [(x, None) for x in none]
    df = docs(spark, [(i, x) for i, (x, _) in enumerate(rows)])
    out = {r["doc_id"]: r["licences"] for r in licences.scan(df, licences.train(spark, df.select("text"))).collect()}
    assert [out[i] for i in range(len(rows))] == [[k] if k else [] for _, k in rows]
    assert licences.scan(df.limit(0), licences.train(spark, df.limit(0).select("text"))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="ad">Buy &amp; win</div><article class="post"><h1>Head</h1><p>One  <b>bo</b>ld &eacute;<p>Two<br>lines</p><aside>Side</aside>%s<div id="comments"><p>nice</p></div></article><footer>(c)</footer>"""


def test_html(spark):
    rows = [(1, "http://A.example/x", PAGE % ""), (2, "http://a.example/y?z", PAGE % "<ul><li>x<li>y</ul>" + "</body></html>"), (3, "http://b.example/", "<body><div class='menu'><a>m</a></div><div id=content><p>Long text of the page here.</p><p>More of it.</p></div></body>"), (4, None, None), (5, "x", "")]
    df = ready(spark).createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert out[1] == "Head One bold é Two lines"
    assert out[2] == "Head One bold é Two lines x y"
    assert out[3] == "Long text of the page here. More of it."
    assert out[4] == out[5] == ""
    made = {r["host"]: r["wrapper"] for r in html_text.wrappers(df).collect()}
    assert ")?" in made["a.example"] and "( p # )+" in made["a.example"]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_fixed_slots_and_layouts(spark):
    fixed = "<div><p>Fixed block of the site.</p></div>"
    rows = [(i, "http://c.example/%d" % i, f"<body><article><h1>Title {i}</h1>{fixed}<p>Story number {i}.</p></article></body>") for i in range(4)]
    rows += [(10, "http://c.example/m", "<body><main><p>Main layout.</p></main></body>"), (11, "http://c.example/d", "<body><div id=x><p>Plain layout.</p></div></body>")]
    rows += [(20 + i, "http://d.example/%d" % i, f"<body><div id=post-{slug}><p>Text of {slug} here.</p></div></body>") for i, slug in enumerate(("ant", "bee", "cat"))]
    rows += [(30, None, "<body><article><p>One site.</p></article></body>"), (31, "odd", "<body><div><p>Another site.</p></div></body>")]
    rows += [(40 + i, "http://e.example/", "<body><article><p>Copy.</p></article></body>") for i in range(4)]
    out = {r["page_id"]: r["text"] for r in html_text.extract(ready(spark).createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(4)] == [f"Title {i} Story number {i}." for i in range(4)]
    assert [out[10], out[11], out[30], out[31]] == ["Main layout.", "Plain layout.", "One site.", "Another site."]
    assert [out[20 + i] for i in range(3)] == [f"Text of {x} here." for x in ("ant", "bee", "cat")]
    assert all(out[40 + i] == "Copy." for i in range(4))


def test_wrapper_alignment():
    a, b = html_text.fold(["ul", "li", "#", "li", "#", "li", "#", "/ul"]), html_text.fold(["ul", "li", "#", "/ul", "p", "#"])
    assert a == ["ul", "(", "li", "#", ")+", "/ul"]
    joined = html_text.align(a, b)
    assert joined[0] == "ul" and "(" in joined and joined[-1] == ")?"


def test_registered(spark, sf_dir):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in names


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(11)
    base = words(rng, 100)
    rows = [(i, " ".join(words(rng, 100)), "en", "s" + str(i % 2), 1) for i in range(8)] + [(20, "bad " * 90, "en", "s0", 1), (21, " ".join(base), "en", "s0", 1), (22, " ".join(base[:-1]), None, None, 1), (23, None, "en", "s1", 0)]
    at = ready(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = at.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = common.written(stage(spark, at, ""), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
        if name == "near_dedup":
            assert {r["doc_id"] for r in at.collect()} == {*range(8), 21}
    assert {"ids", "n_tokens"} <= set(at.columns) and at.count() > 0


def test_lines_of_a_bucket_are_all_linked(spark):
    # in one bucket: two lines like nothing else, then two pairs of like lines, then a line that is like b's copy but not like b
    words = {k: [f"{k}{n}" for n in range(60)] for k in "pqabc"}
    near = lambda k, n, m=0: [*words[k][m:n], *[f"x{k}{i}" for i in range(60 - n + m)]]
    texts = [words["p"], words["q"], words["a"], near("a", 57), words["b"], near("b", 56), [*near("b", 56, 4)], words["c"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    rows = docs.selectExpr("1L as key", "struct(id, 0 as first, size(split(text, ' ')) as size) as at", "struct(cast(id as int) as before, 0 as after) as sums")
    made = {r.id.id: r.component.id for r in passages.line_clusters(rows, docs).collect()}

    def alike(x, y):
        s, t = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (x, y))
        return 100 * len(s & t) >= 80 * len(s | t)

    want = {i: i for i in range(len(texts))}
    for _ in texts:
        for i, x in enumerate(texts):
            for j, y in enumerate(texts):
                if alike(x, y):
                    want[j] = min(want[i], want[j])
    assert not alike(texts[4], texts[6]) and alike(texts[5], texts[6])
    assert made == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}


def test_like_pairs_equal_brute_force():
    rng = random.Random(31)
    sets, keys, parts = [], [], []
    for key in range(6):
        common_values = [rng.getrandbits(63) for _ in range(60)]
        for k in range(30):
            base = sets[rng.randrange(len(sets))] if sets and k % 3 else [rng.getrandbits(63) for _ in range(rng.randrange(1, 60))]
            own = base[: len(base) - rng.randrange(0, 1 + len(base) // 6)] + [rng.getrandbits(63) for _ in range(rng.randrange(4))]
            sets.append(list(dict.fromkeys(own + common_values * (k % 2))))
            keys.append(key)
            parts.append(len(parts) if k % 7 else key)

    def groups(pairs):
        made = dict(enumerate(parts))
        for i, j in pairs:
            made = {k: made[i] if v == made[j] else v for k, v in made.items()}
        return {frozenset(k for k in made if made[k] == v) for v in made.values()}

    like = lambda s, t: 100 * len(set(s) & set(t)) >= 80 * len(set(s) | set(t))
    want = [(i, j) for i in range(len(sets)) for j in range(i) if keys[i] == keys[j] and like(sets[i], sets[j])]
    got = passages.like_pairs(np.array(keys), np.array(parts), np.array([len(x) for x in sets]), np.concatenate([np.array(x, np.uint64) for x in sets]))
    assert set(got) <= set(want) and 10 < len(got) < len(want)
    assert groups(got) == groups(want)


def test_unlike_lines_of_a_bucket_make_no_pairs(spark, monkeypatch):
    n, made = 300, []
    docs = spark.createDataFrame([(i, " ".join([*[f"all{k}" for k in range(40)], *[f"x{i}y{k}" for k in range(40)]])) for i in range(n)] + [(n + i, " ".join(f"same{k}" for k in range(60 + i))) for i in range(2)], "id long, text string")
    rows = docs.selectExpr("1L as key", "struct(id, 0 as first, size(split(text, ' ')) as size) as at", "struct(cast(id as int) as before, 0 as after) as sums")
    verified = passages.verified
    monkeypatch.setattr(passages, "verified", lambda pairs, docs: (made.append(pairs.count()), verified(pairs, docs))[1])
    found = {r.id.id: r.component.id for r in passages.line_clusters(rows, docs).collect()}
    assert found == {n: n, n + 1: n}
    assert sum(made) <= passages.TURNS * (n + 2)


def test_mixing_deals_texts_out_once(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), f"s{i % 5}" if i % 11 else None) for i in range(900)] + [(None, "a b", "s0"), (1000, None, "s1")]
    df = ready(spark).createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.stage(spark, df, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "text" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert "SortMergeJoin" not in plan
    number = lambda r: -1 if r["doc_id"] is None else r["doc_id"]
    want = sorted((p, number(r)) for r in mixing.mix(df, buckets=16).collect() for p in r["positions"])
    for spans in (1, 64):  # 64: most parts meet several spans
        out = mixing.stream(df, buckets=16, spans=spans)
        assert out.columns == df.columns
        assert [number(r) for r in out.collect()] == [i for _, i in want]


def test_tidy_gives_native_memory_back(spark, monkeypatch):
    said = []
    trim = common.trim
    monkeypatch.setattr(common, "trim", lambda s: said.append(trim(s)))
    common.tidy(spark)
    version = spark.sparkContext._jvm.java.lang.System.getProperty("java.version")
    assert len(said) == 1 and (said[0].startswith("Trim native heap") or int(version.split(".")[0]) < 17)
