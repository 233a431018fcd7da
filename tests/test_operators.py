"""Rules that hold of comparisons, votes and sources."""

import json

from pyspark.sql import functions as F

from specloom.functions import lexicon as lx
from specloom.functions import udfs
from specloom.operators import compare, consensus, extract, linkage, quality, reports
from specloom.plans import facade
from specloom.sources import corpus as src


def pages(spark, rows):
    return spark.createDataFrame(rows, "spec string, page_number int, text string")


def test_same_documents_have_no_change(spark):
    p = pages(spark, [("a", 1, "A1.1 First part\nThe manager must wait 5 cycles."), ("a", 2, "NOTE: stable.\nIt shall hold.")])
    assert facade.compare_pages(p, p).count() == 0


def test_matches_are_one_to_one(spark, sf_dir):
    from specloom import catalog

    rows = catalog.QUERIES["similar_match"](spark, sf_dir)
    assert rows.groupBy("spec", "old_idx").count().filter("count > 1").count() == 0
    assert rows.groupBy("spec", "new_idx").count().filter("count > 1").count() == 0
    assert rows.filter(F.col("score") < lx.THRESHOLDS["page"]).count() == 0


def test_numeric_change_and_bucket(spark):
    old = pages(spark, [("a", 1, "The manager must hold AWVALID high for exactly 5 cycles after reset.")])
    new = pages(spark, [("a", 1, "The manager must hold AWVALID high for exactly 6 cycles after reset.")])
    changes = facade.compare_pages(old, new)
    row = reports.placed(changes.filter("area = 'requirement'")).first()
    assert row["change_type"] == "modified"
    assert row["difference_category"] == "numeric_value_change"
    assert row["detail"] == "Changed '5' to '6'"
    assert (row["report_section"], row["report_category"]) == ("Critical Changes", "Numeric changes")


def test_empty_items_match_nothing(spark):
    items = spark.createDataFrame([("a", 0, "", "", 1, None)], "spec string, idx int, content string, preview string, page int, section string")
    kinds = {r["change_type"] for r in compare.area_changes(items, items, "note").collect()}
    assert kinds == {"removed", "added"}


def test_duplicates_zip_in_order(spark):
    rows = spark.createDataFrame([("a", i, "same") for i in range(3)], "spec string, idx int, content string")
    m = linkage.exact_matches(linkage.records(rows), linkage.records(rows.filter("idx < 2")))
    assert sorted((r["old_idx"], r["new_idx"]) for r in m.collect()) == [(0, 0), (1, 1)]


def test_f1_is_symmetric(spark):
    a = spark.createDataFrame([("s", "x", 2), ("s", "y", 1)], "spec string, key string, n long")
    b = spark.createDataFrame([("s", "x", 1), ("s", "z", 3)], "spec string, key string, n long")
    assert quality.f1(a, b).first()["f1"] == quality.f1(b, a).first()["f1"] == round(200 / 7, 6)


def test_votes_count_an_agent_once(spark):
    schema = "agent int, page_a int, page_b int, section_a string, section_b string, category string, reason string"
    rows = [(a, 1, 2, " A1 ", "a2", "X", f"r{a}") for a in (0, 0, 1, 2)] + [(3, 1, 2, "a1", "A2", "x", "r3")]
    found = consensus.majority(spark.createDataFrame(rows, schema)).collect()
    assert [(r["votes"], r["descriptions"]) for r in found] == [(4, ["r0", "r1", "r2", "r3"])]
    assert consensus.majority(spark.createDataFrame(rows[:4], schema)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "document.json").write_text(json.dumps({"document_name": "d", "pages": [{"page_number": 1, "text": "x"}], "tables": None}))
    row = src.read_documents(spark, str(tmp_path / "document.json")).first()
    assert row["document_name"] == "d" and row["pages"][0]["page_number"] == 1 and row["acronyms"] is None
    keys = src.read_document_keys(spark, str(tmp_path / "document.json"))
    assert quality.required_fields(keys).first()["required_json_field"] == 100 * 3 / 12
    (tmp_path / "t.csv").write_text('0,1\n"a, b", c\n,\n"say ""x""",2\n')
    cells = [r["cells"] for r in src.read_tables(spark, str(tmp_path / "t.csv")).orderBy("row_idx").collect()]
    assert cells == [["0", "1"], ["a, b", "c"], ['say "x"', "2"]]
    (tmp_path / "agent_3.json").write_text(json.dumps({"inconsistencies": [{"title": "t", "page_a": 4}]}))
    found = src.read_findings(spark, str(tmp_path / "agent_*.json")).collect()
    assert [(r["agent"], r["title"], r["page_a"]) for r in found] == [(3, "t", 4)]


def test_writers(spark, tmp_path):
    old = pages(spark, [("a", 1, "NOTE: one thing.\nIt must wait 5 cycles for reset to end.")])
    new = pages(spark, [("a", 1, "It must wait 7 cycles for reset to end.")])
    facade.compare_and_write(old, new, str(tmp_path))
    lines = spark.read.option("header", True).csv(str(tmp_path / "version_differences.csv"))
    assert lines.columns == reports.CSV_COLUMNS and lines.count() > 0
    assert any("# Specification Version Comparison Report" in r["value"] for r in spark.read.text(str(tmp_path / "version_differences.md")).collect())


def test_page_streams(spark, tmp_path):
    from specloom.streaming import pages as streams

    spark.createDataFrame([("a", 1, 1, "It must wait."), ("a", 1, 2, "NOTE: all.")], "spec string, version int, page_number int, text string").write.parquet(str(tmp_path / "in"))
    stream = streams.stream_requirements(spark.readStream.schema("spec string, version int, page_number int, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("req").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["text"] for r in spark.table("req").collect()] == ["It must wait."]


def test_plan_filter_falls_back(spark):
    s = spark.createDataFrame([("a", 1, i, 0, f"{i}.1", f"T{i}") for i in range(1, 6)], "spec string, version int, page_number int, pos int, id string, title string")
    assert sorted(r["section"] for r in facade.plan_filter(s).collect()) == ["1.1", "2.1", "3.1"]


def test_cover_and_overlap(spark):
    cover = "Chapter A1\nIntroduction\nA1.1 x\nA1.2 y\nA1.3 z"
    df = spark.createDataFrame([(cover,), ("text",)], "text string")
    assert [r["x"] for r in df.select(extract.is_cover("text").alias("x")).collect()] == [True, False]


DOC = {
    "document_name": "spec", "total_pages": 2, "metadata": {"title": "T", "version": "1"},
    "sections": [{"id": "A1", "title": "One"}, {"id": "", "title": "Loose"}, {"id": "A1", "title": "Again"}],
    "requirements": [{"page": 1, "section": "A1", "category": "Functional", "text": "The widget must spin."}],
    "figures": [{"page": 2, "caption": "Figure 1: the old wheel turns"}], "tables": [{"page": 1, "csv_file": "t.csv", "caption": "Table 1: sizes"}],
    "notes": [], "acronyms": [], "cross_references": ["Table 1"], "semantic_chunks": [{"section": "A1", "pages": [1, 2], "text": "x"}],
    "pages": [
        {"page_number": 1, "text": "The widget must spin. See Table 1.", "requirements": [{"page": 1, "section": "A1", "category": "Functional", "text": "The widget must spin."}], "table_captions": [{"caption": "Table 1: sizes"}]},
        {"page_number": 2, "text": "Figure 1: the old wheel turns", "figures": [{"page": 2, "caption": "Figure 1: the old wheel turns"}]},
    ],
}


def test_documents_to_changes_and_reports(spark, tmp_path):
    from specloom.plans import documents as plans

    new = json.loads(json.dumps(DOC))
    new["metadata"]["version"] = "2"
    new["figures"][0]["caption"] = "Figure 1: the new wheel turns"
    new["sections"][2]["title"] = "Other"
    for name, doc, cell in (("old", DOC, "5"), ("new", new, "6")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "document.json").write_text(json.dumps(doc))
        (tmp_path / name / "t.csv").write_text(f'Name,Size\n"a ""b""\nc",{cell}\n,\nlast one,seven\n')

    def load(name):
        docs = plans.with_spec(src.read_documents(spark, str(tmp_path / name / "document.json")))
        return docs, src.read_tables(spark, str(tmp_path / name / "t.csv")).select(F.regexp_extract("source_path", "[^/]*$", 0).alias("csv_file"), "row_idx", "cells")

    (a, x), (b, y) = load("old"), load("new")
    assert [r["cells"] for r in x.orderBy("row_idx").collect()] == [["Name", "Size"], ['a "b" c', "5"], ["last one", "seven"]]
    keys = sorted(r["key"] for r in plans.version_tables(a, x)["section"].collect())
    assert keys[:2] == ["A1", "A1:3"] and keys[2].startswith("title:") and keys[2].endswith(":2") and len(keys) == 3
    changes = plans.compare_documents(a, b, x, y).cache()
    found = {(r["area"], r["change_type"], r["difference_category"]): r for r in changes.collect()}
    assert set(found) == {("metadata", "modified", "metadata_change"), ("section", "modified", "content_change"), ("figure", "modified", found_category(found, "figure")), ("table", "modified", "numeric_value_change")}
    assert found["metadata", "modified", "metadata_change"]["identifier"] == "version"
    assert found["table", "modified", "numeric_value_change"]["preview"] == "Name | Size"
    facade.write_reports(changes, str(tmp_path / "out"), {"old_document": "old", "new_document": "new"})

    def joined(name):
        return "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out" / name).glob("part-*")))

    report = json.loads(joined("version_differences.json"))
    assert report["summary"]["total_changes"] == 4 == len(report["changes"]) and report["summary"]["by_area"]["table"] == 1
    assert [list(v) for v in report["organized_changes"].values()] == [[n for n, _ in bs] for _, bs in reports.LAYOUT]
    assert report["organized_changes"]["Content Changes"]["Modified tables"][0]["area"] == "table"
    text = joined("version_differences.md")
    assert text.startswith("# Specification Version Comparison Report") and "**Total changes:** 4" in text and "| table | 1 |" in text and "### Modified tables (1)" in text
    assert joined("version_differences.csv").split("\n")[0] == ",".join(reports.CSV_COLUMNS)


def found_category(found, area):
    return next(k[2] for k in found if k[0] == area)


def test_quality_scores_by_hand(spark, tmp_path):
    from specloom.plans import documents as plans

    (tmp_path / "document.json").write_text(json.dumps(DOC))
    docs = plans.with_spec(src.read_documents(spark, str(tmp_path / "document.json")))
    keys = src.read_document_keys(spark, str(tmp_path / "document.json")).select(F.lit("spec").alias("spec"), "keys")
    source = pages(spark, [("spec", 1, "The widget must spin. See Table 1."), ("spec", 2, "Figure 1: the old wheel turns")])
    document = plans.tables(docs) | {"keys": keys}
    full = {r["component"]: r["value"] for r in quality.score_completeness(source, document, extended=True).collect()}
    assert len(full) == 7 and full["record_field_completeness_score"] == 100 and full["page_coverage_score"] == 100
    assert full["cross_reference_recall_score"] == 100 and full["requirement_recall_score"] == 100
    exact = {r["component"]: r["value"] for r in quality.score_accuracy(source, document, extended=True).collect()}
    assert len(exact) == 8 and exact["page_text_fidelity_score"] == 100 and exact["json_internal_consistency_score"] == 100
    assert exact["axi_signal_fidelity_score"] == exact["riscv_csr_fidelity_score"] == 100
    gold = {r["component"]: r["value"] for r in quality.score_accuracy(source, document, document).collect()}
    assert len(gold) == 5 and set(gold.values()) == {100.0}
    seen = spark.createDataFrame([("spec", "1", 1), ("spec", "2", 1)], "spec string, key string, n long")
    got = {r["component"]: r["value"] for r in quality.score_capture(source, document, seen, seen.limit(0)).collect()}
    assert got["table_detection_f1_score"] == round(200 / 3, 6) and got["figure_caption_f1_score"] == 100 and got["table_file_existence_score"] == 0
    parts = spark.createDataFrame([("s", "one", "x", 100.0), ("s", "two", "y", 92.0)], "spec string, score string, component string, value double")
    row = quality.report(quality.score(parts)).first()
    assert (row["overall"], row["status"]) == (96.0, "pass")  # the mean alone decides


def test_encoding_rules(spark):
    text = "0b000 WRITE-NOSNOOP The line must be written 0b001 READ It must hold A2.3 Signals and more"
    got = [r["text"] for r in extract.encoding_rules(pages(spark, [("a", 1, text)]), ("spec",)).orderBy("pos").collect()]
    assert got == ["0b000 | WRITE-NOSNOOP | The line must be written", "0b001 | READ | It must hold"]


def test_specification_run(spark):
    cover = "Chapter A2\nOverview\n• A2.1 One\n• A2.2 Two\n• A2.3 Three\nThe cover must not count."
    first = "A2.1 Signal rules\nThe manager must hold AWVALID until ready.\n0b000 WRITE-NOSNOOP The line must be written 0b001 READ It must hold A2.3 more"
    rows = pages(spark, [("a", 1, cover), ("a", 2, first), ("a", 3, "The manager must hold  AWVALID until ready. The subordinate must wait."), ("b", 1, "")])
    blocks = spark.createDataFrame([("a", 3, 0, 0, [("A2.2 ", 9.0), ("Layout part", 11.0)])], "spec string, page_number int, pos int, type int, spans array<struct<text: string, size: double>>")
    made = facade.extract_specification(rows, blocks, ("spec",))
    got = made["requirements"].orderBy("page_number", "pos").collect()
    assert [(r["page_number"], r["section"], r["type"]) for r in got] == [(2, "A2.1", "protocol_rule"), (2, "A2.1", "encoding_rule"), (2, "A2.1", "encoding_rule"), (3, "A2.2", "protocol_rule")]
    assert [r["id"] for r in got] == ["REQ_A2_1_001", "REQ_A2_1_002", "REQ_A2_1_003", "REQ_A2_2_001"]
    assert "AWVALID" in got[0]["signals"] and got[0]["source_section"] == "A2.1" and "cover" not in " ".join(r["text"] for r in got)
    third = [(r["section_id"], r["font_size"]) for r in made["headings"].filter("page_number = 3").collect()]
    assert third == [("A2.2", 11.0)]


def test_results_as_json_and_text(spark, tmp_path):
    from specloom.functions import text as tx
    from specloom.sources import files

    votes = spark.createDataFrame([(a, 1, 2, "A1", "B1", "numeric", t) for a, t in [(1, "one"), (2, None), (3, "three"), (4, "four")]] + [(a, 3, None, None, None, "other", None) for a in (1, 2, 3, 4)], "agent int, page_a int, page_b int, section_a string, section_b string, category string, reason string")
    consensus.write_result(consensus.merged(consensus.majority(votes)), str(tmp_path / "majority"))
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "majority").glob("part-*")))
    assert [(x["page_a"], x["description"]) for x in json.loads(text)["inconsistencies"]] == [(1, "one"), (3, "")]
    parts = spark.createDataFrame([("s", "completeness", "x", 100.0), ("s", "accuracy", "requirement_f1_score", 92.0)], "spec string, score string, component string, value double")
    scores = quality.score(parts)
    inputs = F.struct(F.lit("d.json").alias("json"), F.lit(None).cast("string").alias("pdf"))
    report = json.loads(quality.report_json(scores, inputs).first()["value"])
    assert report["inputs"] == {"json": "d.json", "pdf": None} and (report["overall_percentage"], report["overall_status"]) == (96.0, "pass")
    assert report["scores"]["accuracy"] == {"percentage": 92.0, "status": "fail", "formula": quality.FORMULAS["accuracy_gold"], "details": {"requirement_f1_score": 92.0}}
    lines = quality.report_text(scores, spark.createDataFrame([("s", "d.json", None, None)], "spec string, json string, pdf string, gold_json string")).first()["value"].split("\n")
    assert lines[2:5] == ["JSON: d.json", "PDF:  not supplied/found", ""] and lines[5] == "accuracy: 92.00% - fail" and lines[-1] == "overall: 96.00% - pass"
    assert files.exit_code(quality.report(scores)) == 0 and files.exit_code(quality.report(scores, threshold=97.0)) == 1
    one = spark.createDataFrame([(None, " ", "R7", 3, bytearray(b"\x00\x01"))], "requirement_id string, id string, name string, idx int, content binary")
    row = files.encoded(one).select("base64", tx.requirement_id_key("idx", "requirement_id", "id", "name").alias("a"), tx.requirement_id_key("idx", "id").alias("b"), tx.page_key(F.lit(None), "idx").alias("c"), tx.timestamp(F.lit("2024-01-02 03:04:05.678").cast("timestamp")).alias("t")).first()
    assert tuple(row) == ("AAE=", "REQ:R7", "REQ:3", "3", "2024-01-02T03:04:05")
    facade.write_results({"quality_report": scores}, str(tmp_path / "out"))
    assert sorted(r["score"] for r in spark.read.json(str(tmp_path / "out" / "quality_report.json")).collect()) == ["accuracy", "completeness"]


def test_documents_by_ending(spark, tmp_path):
    import pytest

    from specloom.sources import files

    (tmp_path / "document.json").write_text(json.dumps(DOC))
    assert files.read_any(spark, str(tmp_path / "document.json")).first()["total_pages"] == 2
    assert files.read_any(spark, "x.PDF", lambda s, p: s.range(1)).count() == 1
    with pytest.raises(ValueError):
        files.read_any(spark, "x.pdf")


def test_candidates_in_blocks(spark, monkeypatch):
    # the best by common tokens among the first forty, then by the first common one, then by place; over several blocks of old items
    chance = __import__("random").Random(3)
    words = [f"w{n:03}" for n in range(80)]
    rows = {v: [("s", i, " ".join(dict.fromkeys(chance.choices(words, k=chance.choice((0, 3, 50)))))) for i in range(60)] for v in (1, 2)}
    old, new = (linkage.records(spark.createDataFrame(rows[v], "spec string, idx int, content string")) for v in (1, 2))
    monkeypatch.setattr(linkage, "BLOCK", 7)
    got = {(r.old_idx, r.new_idx, r.shared, r.rank) for r in linkage.candidates(old, new).collect()}
    likely = {(r.old_idx, r.new_idx, r.rank) for r in linkage.likely_candidates(old, new).collect()}
    want, fit = set(), set()
    for _, i, a in rows[1]:
        a, every = a.split()[:40], set(a.split())
        found = []
        for _, j, b in rows[2]:
            same = [k for k, w in enumerate(a) if w in b.split()[:40]]
            if same:
                found.append((-len(same), same[0], j))
        for k, (n, _, j) in enumerate(sorted(found)[:20]):
            want.add((i, j, -n, k + 1))
            b = set(rows[2][j][2].split())
            lengths = sorted((len(rows[1][i][2]), len(rows[2][j][2])))
            if lengths[0] / lengths[1] >= 0.35 and len(every & b) / len(every | b) >= 0.08:
                fit.add((i, j, k + 1))
    assert got == want and likely == fit and len(fit) < len(want)


def test_candidates_by_all_tokens(spark, tmp_path):
    # the common words of the first two documents lie behind their first forty; the query and its SQL count them
    import duckdb

    from specloom import catalog

    words = lambda c, n: [f"{c}word{k}" for k in range(n)]
    texts = [" ".join(words(c, 50) + words("all", 60)) for c in "ab"] + [" ".join(words(c, 30) + ["allword1"]) for c in "cdefg" * 8]
    spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(texts)], "source string, doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["token_candidates_top20"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog.ORACLES["token_candidates_top20"]).fetchall())
    shared = {(old, new): n for _, old, new, n, _ in got}
    assert shared[0, 1] > 60 and shared[1, 1] > 110


def test_similar_matches_copy_no_text_to_its_pairs(spark):
    text = [" ".join(f"word{(i * 7 + k * k) % 90}" for k in range(30)) for i in range(40)]
    side = lambda rows: linkage.records(spark.createDataFrame(rows, "spec string, idx int, content string"))
    old, new = side([("s", i, t) for i, t in enumerate(text)]), side([("s", i, t + " more") for i, t in enumerate(reversed(text))])
    found = linkage.similar_matches(old, new, 0.3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "normalised" in x] and plan.count("Join") == 1
    assert all(r["score"] == udfs.ratio(text[r["old_idx"]], text[39 - r["new_idx"]] + " more") for r in found.collect())
    assert found.count() == 40


def test_similar_matches_of_all_pairs(spark):
    # more than twenty new items share more tokens with an old one than the one that is most like it; what they have in common may lie
    # behind the first forty tokens; equal texts, and pairs that are matched in steps, come out as the plain greedy choice
    chance = __import__("random").Random(5)
    words = [f"{a}{b}rt{c}" for a in "kmpqz" for b in "aeiou" for c in "lnvx"]
    base = [" ".join(chance.choices(words, k=chance.choice((4, 60, 90)))) for _ in range(14)]
    target = " ".join(words[:12] + ["zzz"] * 40)
    decoys = [" ".join(reversed(words[:30])) + f" d{k} " + " ".join(chance.sample(words, 40)) for k in range(30)]
    bent = lambda t: " ".join(w if chance.random() < 0.8 else chance.choice(words) for w in t.split())
    rows = {1: [target, *base, *base[:5], "", base[0] + " x", *map(bent, base[6:])], 2: [*decoys, *map(bent, base), *map(bent, base[:9]), target.replace("zzz", "zzy"), *base[3:6], base[3] + " y", ""]}
    old, new = (linkage.records(spark.createDataFrame([("s", i, t) for i, t in enumerate(rows[v])], "spec string, idx int, content string")) for v in (1, 2))
    tokens = {v: [list(dict.fromkeys(w for w in t.split() if len(w) > 2)) for t in rows[v]] for v in rows}
    pairs = []
    for i, a in enumerate(rows[1]):
        for j, b in enumerate(rows[2]):
            same = [k for k, w in enumerate(tokens[1][i]) if w in tokens[2][j]]
            if same and min(len(a), len(b)) / max(len(a), len(b)) >= 0.35 and len(same) / len({*tokens[1][i], *tokens[2][j]}) >= 0.08:
                s = round(__import__("difflib").SequenceMatcher(None, a, b).ratio(), 4)
                if s >= 0.3:
                    pairs.append((-s, i, -len(same), same[0], j))
    want, left, right = set(), set(), set()
    for s, i, _, _, j in sorted(pairs):
        if i not in left and j not in right:
            left.add(i), right.add(j), want.add((i, j, -s))
    for near in (None, 0.8, 0.98):
        assert {(r.old_idx, r.new_idx, r.score) for r in linkage.similar_matches(old, new, 0.3, near=near).collect()} == want
    assert (0, 53) in {w[:2] for w in want} and len(want) > 12


def test_most_matched_is_a_bound():
    chance = __import__("random").Random(1)
    for alphabet in ("ab", "abcdefgh xyz.,", "a\u00e9\u4e2d\u6587 \x00b", "abcdefghijklmnopqrstuvwxyz0123456789 "):
        for _ in range(60):
            parts = ["".join(chance.choices(alphabet, k=chance.randint(1, 9))) for _ in range(12)]
            made = lambda: "".join(chance.choice(parts) + chance.choice((" ", "", ". ")) for _ in range(chance.randint(1, 120)))  # noqa: E731, B023
            new, olds = made(), [made() for _ in range(3)]
            olds += [new, new[:40] + "x" + new[40:]]
            assert all(udfs.matched(a, new) <= m for a, m in zip(olds, udfs.most_matched(olds, new).tolist(), strict=True))


def test_comparison_goes_through_lines_once(spark, monkeypatch):
    p = pages(spark, [("a", 1, "A1.1 First part\nNOTE: stable.\nFigure 2-1: Handshake\nIt must hold."), ("a", 2, "Table A1-1: Signal list\nplain line"), ("b", 1, "2 Scope here\nFigure A3-2 Reset")])
    whole, kept = facade.extract_pages(p, ("spec",)), facade.extract_pages(p, ("spec",), extract.marked_lines(p, ("spec",)))
    for name in ("headings", "notes", "figures", "table_captions"):
        assert sorted(map(str, whole[name].collect())) == sorted(map(str, kept[name].collect())) and whole[name].count() > 0, name
    calls, lines = [], extract.page_lines
    monkeypatch.setattr(extract, "page_lines", lambda *a: calls.append(1) or lines(*a))
    facade.compare_pages(p, p)
    assert len(calls) == 2


def test_changes_start_from_written_tables(spark):
    side = lambda more: spark.createDataFrame([("s", i, f"Page {i} says that word{i} must hold{more if i % 2 else ''}.", i) for i in range(6)], "spec string, idx int, content string, page int")
    notes = compare.area_changes(*(side(x).selectExpr("*", "content as preview", "cast(null as string) as section") for x in ("", " now")), "note")
    for made, n in ((compare.page_changes(side(""), side(" now")), 0), (notes, 3)):  # pages that match change nothing but their place
        plan = made._jdf.queryExecution().analyzed().toString()
        assert "InMemoryRelation" not in plan and "LogicalRDD" not in plan and "FlatMap" not in plan
        assert made.filter("change_type = 'modified'").count() == n


def test_specification_sentences_steps_run_once(spark):
    from specloom.functions import text as tx

    text = "It must:\n•  hold  1.\n• wait 2.\nTable A1: gone\nPlain words. 3 Data can\x1cnot move. The rest should:\n• The required behavior is: stop.\nSee what must be."
    found = extract.specification_sentences(pages(spark, [("a", 1, text), ("b", 1, None), ("b", 2, "")]), ("spec",))
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [("a", 1, 1, "must: hold 1."), ("a", 1, 2, "must: wait 2."), ("a", 1, 4, "3 Data can not move.")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("The required behavior") == 1 and plan.count("Non-confidential") == 1
    near = spark.createDataFrame([(w.upper().replace(" ", "\t\x1c"),) for w in lx.SPECIFICATION_PHRASES], "s string")
    assert near.filter(F.col("s").rlike(lx.SPECIFICATION_NEAR) & tx.is_specification(tx.squash("s"))).count() == len(lx.SPECIFICATION_PHRASES)
