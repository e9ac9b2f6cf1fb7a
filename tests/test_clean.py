"""Cleaning, correction and validation on small Chinese frames."""

import pytest
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.operators import clean, correct, reports, summarise, validate
from parley.plans import templates
from parley.sources import readers
from parley.streaming import progress


def one(spark, text, job, column="text"):
    row = job(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    return row[column] if column else row


@pytest.mark.parametrize(
    "text, expected",
    [
        ("對對對對對對對", "對對對對對對對"),
        ("對對對對對對對對", "對對"),
        ("請看影片 請看影片 請看影片 請看影片", "請看影片 請看影片"),
        ("請看影片 請看影片 請看影片", "請看影片 請看影片 請看影片"),
        ("好，好，好，好，好，好，好，好，開始", "好，好，開始"),
        ("沒有重複", "沒有重複"),
    ],
)
def test_loops(spark, text, expected):
    assert one(spark, text, clean.collapse_loops) == expected


def test_boilerplate_and_sentences(spark):
    row = one(spark, "會議開始。請訂閱我的頻道。\n\n\n\n散會  了。謝謝觀看", clean.remove_boilerplate, None)
    assert row["text"] == "會議開始。。\n\n散會 了。" and row["boilerplate_removed"] == 2
    assert one(spark, "  照舊  ", clean.remove_boilerplate) == "照舊"
    row = one(spark, "今天開會。今天開會。今天開會。好。好。今天開會。", clean.dedup_consecutive_sentences, None)
    assert row["text"] == "今天開會。好。好。今天開會。" and row["dedup_removed"] == 2


def test_variants_only_in_lines_that_drift(spark):
    job = lambda d: d.withColumn("text", clean.variant_normalised(F.col("text"), {"会": "會", "议": "議", "干": "乾"}))
    assert one(spark, "会议干\n干預", job) == "會議乾\n干預"


def test_terms_placeholders_foreign_lines(spark):
    assert one(spark, "筒任與函辦。", clean.apply_term_fixes) == "簡任與函頒。"
    assert one(spark, "時間：（年）（月）（日）\n內文（年）", clean.repair_placeholders) == "時間：（待確認）\n內文（年）"
    text = "Here's the record\n會議紀錄\nThis is a line of English words\n# Title in English\nuse PyTorch now please"
    assert one(spark, text, lambda d: clean.drop_foreign_lines(d, ["PyTorch"])) == "會議紀錄\n# Title in English\nuse PyTorch now please"
    assert one(spark, "Okay 開始 Action Items", clean.replace_vocabulary) == "好 開始 待辦事項"


def test_structure(spark):
    row = one(spark, "會議名稱：甲\n一、 報告事項：無\n二、討論事項\n案由：乙\n說明：丙\n決議：丁", lambda d: clean.ensure_structure(d, templates.GENERAL_HEADERS, templates.GENERAL_SECTIONS))
    assert row.startswith("會議時間：（待確認）\n會議地點") and row.endswith("辦理期程：（待確認））") and "各單位意見（多方立場）：" in row and row.count("案由：") == 1
    assert one(spark, None, lambda d: clean.ensure_structure(d, templates.GENERAL_HEADERS, templates.GENERAL_SECTIONS)).count("案由：") == 1


def test_wrappers_and_spacing(spark):
    assert one(spark, "<think>嗯</think>\n好的\n# 會議紀錄\n內容\n```", clean.strip_wrappers) == "# 會議紀錄\n內容"
    assert one(spark, "大家 好 ， 今天 use  AI 開會", lambda d: d.withColumn("text", clean.cjk_spaced(F.col("text")))) == "大家好，今天 use AI 開會"


def test_tokens_and_names(spark):
    tokens = lambda t: one(spark, t, lambda d: d.withColumn("n", fx.estimate_tokens(F.col("text"))), "n")
    for t in ["", "會議", "abc def-ghi 12", "會議 agenda，討論！！！！", "a" * 50, "，，，，，"]:
        meter = summarise.Meter()
        assert tokens(t) == [0, *map(meter.add, t)][-1]
    assert tokens(None) == 0
    assert one(spark, "C:\\x\\會議 記錄(1).mp3", lambda d: d.withColumn("n", fx.safe_base_name(F.col("text"))), "n") == "會議 記錄1"


def test_years(spark):
    records = spark.createDataFrame([(1, "中華民國113年，一百一十四年度，90年代，二〇二六年")], "doc_id int, text string")
    said = spark.createDataFrame([(1, "一一三年開始")], "doc_id int, text string")
    assert sorted(r["year"] for r in validate.ungrounded_years(records, said).collect()) == ["114", "2026"]


def test_templates_and_acceptance(spark):
    titles = [(t, title) for t, title, _, _ in templates.TEMPLATES]
    resolve = lambda t: one(spark, t, lambda d: validate.resolve_template(d, titles, "general"), "template_id")
    assert resolve("# 科務會議紀錄\nx") == "section_meeting" and resolve("本科務會議紀錄如下") == "section_meeting" and resolve("x") == "general"
    good = "# 會議紀錄\n" + "\n".join(f"{x}：{'內容' * 20}" for x in ["會議名稱", "會議時間", "會議地點", "主席", "出席人員", "列席人員", "記錄", "一、報告事項", "二、討論事項", "案由", "說明", "各單位意見", "決議", "三、主席裁示事項", "主辦單位", "辦理期程"])
    rows = [(1, "docx", "general", good, 20, 0, 0), (2, "md", "general", "TODO ⚠️", 1, 0, 0)]
    artifacts = spark.createDataFrame(rows, "doc_id int, kind string, template_id string, text string, paragraphs int, tables int, needs_tables int")
    checks = validate.acceptance_checks(artifacts, templates.rules(spark), dict(titles)).cache()
    status = {(r["doc_id"], r["check_id"]): r["status"] for r in checks.collect()}
    assert {v for (d, _), v in status.items() if d == 1} == {"PASS"}
    assert status[2, "structure_nonempty"] == "SKIP" and status[2, "not_fallback"] == "FAIL"
    assert {r["doc_id"]: r["verdict"] for r in validate.verdict(checks).collect()} == {1: "ACCEPTED", 2: "REJECTED"}


def test_form_fields_and_tracking(spark):
    text = "# 紀錄\n專案名稱：甲案\n專案名稱：乙案\n內　容：\n\n一、子項\n二、子項\n\n決議事項：無\n---\n地點：不算"
    rows = {r["field"]: r["value"] for r in validate.extract_form_fields(spark.createDataFrame([(1, text)], "doc_id int, text string"), templates.FORM_FIELDS).collect()}
    assert rows["專案名稱"] == "甲案" and rows["內容"] == "一、子項\n二、子項" and rows["決議事項"] == "無" and rows["地點"] == "（待確認）" and len(rows) == 14
    text = "歷次會議列管案件：無\n\n## 115年科務會議決議事項辦理情形彙整表\n決議事項：\n\n| a | b |\n| --- | --- |\n| c | d |\n尾"
    row = validate.tracking_tables(spark.createDataFrame([(1, text), (2, "x")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert row[0]["previous"].endswith("| 無 |  |  |  |") and row[0]["summary"] == "| a | b |\n| --- | --- |\n| c | d |"
    assert row[1]["previous"].endswith("| （待確認） |  |  |  |") and row[1]["summary"].endswith("| （待確認） | （待確認）： |  |  |")


SYLLABLES = [("張", "zh", "ang"), ("章", "zh", "ang"), ("贓", "z", "ang"), ("三", "s", "an"), ("山", "sh", "an"), ("上", "sh", "ang"), ("里", "l", "i"), ("你", "n", "i"), ("日", "r", "i"), ("大", "d", "a")]


def test_homophones_and_gate(spark):
    syllables = spark.createDataFrame(SYLLABLES, "ch string, initial string, final string")
    near = {(r["a"], r["b"]) for r in correct.near_syllables(syllables).collect()}
    assert ("l|i", "n|i") in near and ("r|i", "l|i") in near and ("n|i", "r|i") not in near and ("s|an", "sh|ang") in near
    segments = spark.createDataFrame([(1, 0, "大贓山大"), (1, 1, "張三"), (1, 2, "大大")], "doc_id int, seg_no int, text string")
    hits = correct.near_homophone_hits(segments, spark.createDataFrame([("張三",)], "term string"), syllables).collect()
    assert [(r["seg_no"], r["start"]) for r in hits] == [(0, 1)]
    base = "".join(chr(0x5000 + i) for i in range(30))
    pairs = [(1, 0, base + "章" + base, base + "張" + base), (1, 1, base + "大" + base, base + "里" + base), (1, 2, base, base + "張"), (1, 3, base + "張", base), (1, 4, "大張大", "里里里"), (1, 5, base, base)]
    texts, changes = correct.gate_corrections(spark.createDataFrame(pairs, "doc_id int, seg_no int, original string, candidate string"), syllables, spark.createDataFrame([("甲", "乙")], "wrong string, right string"))
    got = {r["seg_no"]: (r["text"], r["dropped"]) for r in texts.collect()}
    assert got[0][0] == pairs[0][3] and got[1][0] == pairs[1][2] and got[2][0] == base and got[3][0] == base + "張" and got[4] == ("大張大", True) and got[5] == (base, False)
    assert sorted((r["seg_no"], r["accepted"]) for r in changes.collect()) == [(0, True), (1, False), (2, False), (3, False), (4, False)]


def test_many_wrong_forms_are_joined(spark):
    segments = spark.createDataFrame([(1, 0, "甲乙丙"), (1, 1, "丁"), (2, 0, "戊己")], "doc_id int, seg_no int, text string")
    pairs = spark.createDataFrame([("乙丙", "x"), ("己", "x"), ("庚", "x")], "wrong string, right string")
    for limits in ((2000, 0), (1, 100), (1, 0)):
        assert sorted((r[0], r[1]) for r in correct.needs_correction(segments, pairs, *limits).collect()) == [(1, 0), (2, 0)]


def test_fifty_thousand_forms(spark):
    """An automaton, against the pattern of the same forms; nothing is exploded."""
    segments = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit(0).alias("seg_no"), "text").unionByName(spark.createDataFrame([(-1, 0, None), (-2, 0, "")], "doc_id long, seg_no int, text string"))
    words = sorted({w for r in segments.where("doc_id >= 0").collect() for w in r.text.split()})
    wrong = words[::97] + [f"no such form {i}" for i in range(50_000)]
    pairs = spark.createDataFrame([(w, "x") for w in wrong], "wrong string, right string")
    found = correct.needs_correction(segments, pairs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    assert "Generate" not in plan
    by_pattern = correct.needs_correction(segments, pairs.where("wrong not like 'no such%'"))
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in by_pattern.collect()) != []


def test_chunks_hold_their_invariants(spark):
    long = "，".join("會議討論" * 40 for _ in range(30)) + " word" * 900
    docs = spark.createDataFrame([(1, long), (2, "甲\n乙\n\n丙"), (3, "  "), (4, "x" * 5000)], "doc_id int, text string")
    for budget in (20, 60, 400):
        lines = summarise.chunk_lines(docs, budget).cache()
        chunks = summarise.pack_chunks(lines, budget).cache()
        rows = summarise.check_chunk_coverage(docs, lines, chunks, budget).collect()
        assert {r["doc_id"]: r["verdict"] for r in rows} == {1: "ok", 2: "ok", 3: "blank", 4: "ok"}
        assert all(r["fits"] and r["follows"] and r["complete"] for r in rows)


def test_lost_blank_and_doubled_documents_are_named(spark):
    docs = spark.createDataFrame([(1, "甲\n乙"), (2, "丙"), (3, " \n "), (4, "丁"), (4, "丁"), (5, None), (6, "x " * 50), (7, "a\nb\nc")], "doc_id int, text string")
    lines = summarise.chunk_lines(docs, 40).cache()
    chunks = summarise.pack_chunks(lines, 40).where("doc_id not in (2, 6)").withColumn("doc_id", F.when(F.col("doc_id") == 4, 4).otherwise(F.col("doc_id")))
    stray = spark.createDataFrame([(9, 0, 0, 0, 0), (7, 1, 2, 2, 0)], chunks.schema)
    found = {r.doc_id: (r.verdict, r.error) for r in summarise.check_chunk_coverage(docs, lines, chunks.where("doc_id <> 7").unionByName(stray), 40).collect()}
    bad = summarise.BUDGET_EXCEEDED
    assert found == {1: ("ok", None), 2: ("lost", bad), 3: ("blank", None), 4: ("doubled", bad), 5: ("blank", None), 6: ("lost", bad), 7: ("overlap", bad), 9: ("unknown", bad)}


def test_note_actions(spark):
    notes = "\n".join(["| 待辦事項 | 負責 | 期限 |", "|---|---|---|", "| 完成整合測試 | 甲 | 週三 |", "| 二格 | x |", "| 本次會議未明確指派待辦事項 | | |", "|| 補件：三份 | 乙 | |", "  | 完成整合測試 | 丙 | |  ", "| ： | - | - |", "no | table | row", "| :--- | a | b |"])
    df = spark.createDataFrame([(1, notes), (2, None)], "doc_id int, text string")
    actions = validate.note_actions(df)
    assert sorted(r.action for r in actions.collect()) == ["完成整合測試", "完成整合測試", "補件：三份"]
    records = spark.createDataFrame([(1, "請於週三前完成 整合測試。"), (2, "無")], "doc_id int, text string")
    assert sorted(tuple(r) for r in validate.action_recall(actions, records).collect()) == [(1, 2, 1), (2, 0, 0)]


def test_all_issues_of_a_record(spark):
    rules = templates.rules(spark, [("general", "required", "時間", "^時間"), ("general", "forbidden", "電話", r"\d{8}")])
    records = spark.createDataFrame([(1, "general", "地點：甲\n113年完成，電話 12345678"), (2, "general", "時間：今日"), (2, "other", "x")], "doc_id int, template_id string, text string")
    notes = spark.createDataFrame([(1, "| 送件 | 甲 | 乙 |"), (1, "| 完成 | 甲 | 乙 |")], "doc_id int, text string")
    said = spark.createDataFrame([(1, "去年的事"), (3, "112年")], "doc_id int, text string")
    found = validate.issue_list(validate.quality_evidence(records, notes, said), rules, 3, traced=["general"])
    assert sorted((r.doc_id, r.template_id, r.issues) for r in found.collect()) == [
        (1, "general", ["missing: 時間", "forbidden: 電話", "missing actions: 1", "no source tag", "ungrounded years: 113"]),
        (2, "general", ["no source tag"]),
        (2, "other", ["too short"]),
    ]


def test_records_go_again_until_all_checks_hold(spark):
    """M12 with V8: the model adds what the issues name."""
    rules = templates.rules(spark, [("general", "required", "時間", "時間")])
    notes = spark.createDataFrame([(1, "| 送件 | 甲 | 乙 |"), (2, "")], "doc_id int, text string")
    source = spark.createDataFrame([(1, "開會"), (2, "開會時間")], "doc_id int, text string")

    def model(texts):
        return texts.map(lambda t: t.split("\n")[0] + ("。時間" if "missing: 時間" in t else "") + ("。送件" if "missing actions" in t else ""))

    def issues(df):
        evidence = validate.quality_evidence(df.select("doc_id", F.lit("general").alias("template_id"), "text"), notes, source)
        return validate.quality_issues(evidence, rules, 1)

    found = summarise.generate_and_refine(source, model, lambda r: r, issues)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "開會。時間。送件", 1, ""), (2, "開會時間", 0, "")]


def test_model_errors_become_rows(spark):
    def flaky(texts):
        if (texts == "bad").any():
            raise ValueError("refused")
        return texts.str.upper()

    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "bad"), (2, 1, "c")], "doc_id int, chunk_no int, text string")
    notes, failed = summarise.extract_notes(chunks, flaky, parallel=2)
    assert sorted(r["text"] for r in notes.collect()) == ["A", "B"] and [tuple(r) for r in failed.collect()] == [(2, "refused")]


def test_merge_converges_or_says_so(spark):
    notes = spark.createDataFrame([(1, i, "word " * 20) for i in range(8)] + [(2, i, "字" * 50) for i in range(4)], "doc_id int, note_no int, text string")
    rows = {r["doc_id"]: r for r in summarise.merge_until_fit(notes, lambda s: s.map(lambda t: t if "字" in t else t[:60]), 100, 40, 45).collect()}
    assert rows[1]["error"] is None and rows[1]["text"] and rows[2]["error"] == summarise.NOT_CONVERGED


def test_refine_only_what_fails(spark):
    docs = spark.createDataFrame([(1, "ok"), (2, "short")], "doc_id int, text string")
    model = lambda s: s.map(lambda t: "fixed" if "[issues]" in t else t)
    issues = lambda r: r.where("text = 'short'").select("doc_id", F.lit("too short").alias("issue"))
    assert sorted(map(tuple, summarise.generate_and_refine(docs, model, lambda r: r, issues).collect())) == [(1, "ok", 0, ""), (2, "fixed", 1, "")]


def test_glossary_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n甲\n錯=>對\n\n甲\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("對\n乙\n", encoding="utf-8")
    terms, pairs = readers.read_glossary(spark, str(tmp_path))
    assert [r["term"] for r in terms.orderBy("ord").collect()] == ["甲", "對", "乙"] and [(r["wrong"], r["right"]) for r in pairs.collect()] == [("錯", "對")]


def test_payload_and_catalog_files(spark, tmp_path):
    (tmp_path / "m1.json").write_text('{"chunks": [{"start": 0.5, "end": 1.25, "text": " 好 "}, {"start": null, "end": null, "text": "x"}, {"text": " "}]}', encoding="utf-8")
    (tmp_path / "m2.json").write_text("{broken", encoding="utf-8")
    segments, bad = readers.read_asr_payloads(spark, str(tmp_path))
    assert sorted(map(tuple, segments.collect())) == [("m1", 0, 500, 1250, "好"), ("m1", 1, 1250, 1250, "x")] and [tuple(r) for r in bad.collect()] == [("m2", "not json")]
    (tmp_path / "A.MP3").write_bytes(b"123")
    assert [(r["name"], r["bytes"]) for r in readers.scan_media_catalog(spark, str(tmp_path)).collect()] == [("A.MP3", 3)]


def test_fractions(spark):
    lines = ['{"fraction": 0.5}', '{"percent": 30}', '{"progress": 250}', '{"progress": -1}', "noise", "7", '{"fraction": "bad", "value": 0.2}', None]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(progress.progress_fraction(F.col("line")).alias("f"))
    assert [r["f"] for r in df.collect()] == [0.5, 0.3, 1.0, 0.0, None, None, 0.2, None]


def test_similarity(spark):
    rows = spark.createDataFrame([(1, "今天開會（備註）", "今天,開會"), (2, "abc", None)], "item_no int, text string, predicted string")
    assert [r["similarity"] for r in reports.score_alignment(rows, "ratio").orderBy("item_no").collect()] == [1.0, 0.0]
    assert [r["similarity"] for r in reports.score_alignment(rows).orderBy("item_no").collect()] == [1.0, 0.0]


@pytest.mark.parametrize("max_terms", [200, 0])
def test_homophones_by_pattern_and_by_join(spark, max_terms):
    letters = {"b": ("zh", "a"), "d": ("z", "a"), "o": ("", "o"), "e": ("", "e"), "x": ("x", "i")}
    syllables = spark.createDataFrame([(c, i, f) for c, (i, f) in letters.items()], "ch string, initial string, final string")
    texts = ["debe", "dodo dodo", "bobo", "b-e b o x", "bbebe", "", None, "ex ex"]
    segments = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, seg_no int, text string")
    terms = spark.createDataFrame([("bobo",), ("be",), ("bobo",), ("q",), ("qq",), ("b",)], "term string")
    alike = {("b", "d"), ("o", "e")}
    near = lambda a, b: a == b or (a, b) in alike or (b, a) in alike
    expected = []
    for i, t in enumerate(texts):
        p = "".join(c for c in t or "" if "a" <= c <= "z")
        for term in ("bobo", "be"):
            if term not in p:
                expected += [(i, term, s) for s in range(len(p) - len(term) + 1) if all(near(x, y) for x, y in zip(p[s:], term, strict=False))]
    rows = correct.near_homophone_hits(segments, terms, syllables, "[a-z]", max_terms=max_terms).collect()
    assert sorted((r["seg_no"], r["term"], r["start"]) for r in rows) == sorted(expected) and expected


def test_a_text_with_the_mark_itself_keeps_it(spark):
    row = one(spark, "￿對對對對對對對對 請看影片 請看影片 請看影片 請看影片", clean.collapse_loops, None)
    assert row["text"] == "￿對對 請看影片 請看影片" and row["loops_collapsed"] == 2
    assert one(spark, None, clean.collapse_loops, None)["loops_collapsed"] is None


def test_proposals_leave_no_text_out(spark):
    from parley.plans import frames as fr
    from parley.plans import q_correct

    sf = "/root/testdata/sf0.001"
    made = q_correct.proposals(spark, sf).agg(F.sum(F.length("original")), F.max(F.length("original"))).first()
    assert made[0] == fr.documents(spark, sf).agg(F.sum(F.length("text"))).first()[0] and made[1] <= 400
