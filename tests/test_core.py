"""Literal fixtures of the rules that the plain tables never reach, and metrics computed by hand."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, evaluate, gates, graph, ingest, layout, ops, retrieval
from docloom.sources import readers, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_tokens_split_at_accents(spark):
    assert one(spark, T.tokens(F.lit("L'Élan a 한국어 ㄱㄴ x1")))[0] == ["lan", "한국어", "ㄱㄴ", "x1"]
    assert one(spark, T.keywords(F.lit("the cat and the Cat of 12, what guide")))[0] == ["cat", "of", "12"]


def test_spaces_are_unicode(spark):
    assert one(spark, T.collapse(F.lit("　a  b\n")), T.compact(F.lit("A b"))) == ("a b", "ab")


def test_section_and_page_lines(spark):
    for line, section in (("## Head", True), ("1.2.3 Scope", True), ("가) 항목", True), ("제 3 조 목적", True), ("plain", False), ("12", False)):
        assert one(spark, T.is_section(F.lit(line)))[0] is section, line
    for line, page in (("Page 3 of 9", True), ("3 / 9", True), ("-----", True), ("pages", False), ("", True)):
        assert one(spark, T.is_page_line(F.lit(line)))[0] is page, line


def test_column_letters(spark):
    assert one(spark, *[T.column_letters(F.lit(n)) for n in (1, 26, 27, 52, 703)]) == ("A", "Z", "AA", "AZ", "AAA")


def test_estimators(spark):
    assert one(spark, T.chunk_tokens(F.lit("")), T.chunk_tokens(F.lit("!")), T.mixed_tokens(F.lit("ab 가나 !")), T.server_tokens(F.lit("abcdefghi"))) == (0, 1, 3, 3)


def test_critical_terms_lose_one_particle(spark):
    assert one(spark, gates.critical_terms(F.lit("농가를 조사 대상으로는 벼농사가 123 벼농사")))[0] == ["벼농사"]


def test_number_anchors(spark):
    for text, hit in (("3. item", True), ("see 3번", True), ("제 3 조", True), ("[3]", True), ("result 3", True), ("13. item", False), ("3x", False)):
        assert one(spark, gates.number_anchor(F.lit(text), F.lit("3")))[0] is hit, text
    assert one(spark, gates.expand_number_refs(F.lit("3번 알려줘")))[0].startswith("3번 알려줘 3번 3. 3 항목")


def test_signatures_are_exact(spark):
    got = one(spark, answers.numeric_signatures(F.lit("단가=30, 1,500원 2.50% 3억원 5(천원) 12명 [DOC 9]")))[0]
    assert got == sorted(["money:30000", "money:1500", "percent:2.5", "money:300000000", "money:5000", "count:12:명"])
    assert one(spark, answers.temporal_signatures(F.lit("2024년 3월 상반기")))[0] == ["time:2024년", "time:3월", "timekw:상반기"]


def test_name_aliases(spark):
    assert one(spark, ingest.name_aliases(F.lit("가계조사(도시)")))[0] == ["가계조사(도시)", "가계조사", "도시"]
    assert one(spark, ingest.name_aliases(F.lit("농·어가조사")))[0] == ["농·어가조사", "농어가조사", "농가조사", "어가조사"]


def test_row_fact_prices(spark):
    got = one(spark, ingest.row_fact(F.array(F.lit("조사명"), F.lit("지급단가")), F.array(F.lit("가계조사"), F.lit("30"))))[0]
    assert got == "표의미: kind=table_row | subject=가계조사 | aliases=가계조사 | 조사명=가계조사 | 지급단가=30천원"


def test_facts_of_definition_paths(spark):
    rows = spark.createDataFrame([(1, "표의미: kind=definition_block | subject=가구 > 1인가구 | 정의=혼자 사는 가구\nother")], "id long, text string")
    got = {(r.subject, r.predicate, r.object_value, r.fact_kind) for r in ingest.extract_facts(rows, "id").collect()}
    assert got == {("1인가구", "정의", "혼자 사는 가구", "definition_block"), ("1인가구", "상위개념", "가구", "hierarchy")}


def test_retention_caps_after_expiry(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 80), (4, 90)], "id long, at long")
    got = {r.id: r.removed for r in ops.prune(rows, "id", "at", 50, 1, 100).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_two_hops_need_a_predicate(spark):
    facts = spark.createDataFrame(
        [(1, "사과", "상위개념", "과일", 0.9, "active"), (2, "사과", "가격", "천원", 0.9, "active"), (3, "배", "가격", "백원", 0.3, "active"), (4, "감", "가격", "이백원", 0.3, "published")],
        "fact_id long, subject string, predicate string, object string, confidence double, status string",
    )
    q = spark.createDataFrame([(1, "사과 가격"), (2, "과일 가격"), (3, "과일 모양"), (4, "배나무 배 가격"), (5, "감나무 가격")], "query_id long, query string")
    got = {(r.query_id, r.fact_id): r for r in graph.fact_scores(q, facts).collect()}
    assert got[1, 2].hops == 1 and got[2, 2].hops == 2 and got[2, 2].score < got[1, 2].score
    assert (3, 2) not in got and (4, 3) not in got


def test_feedback_counts_once(spark):
    facts = spark.createDataFrame([(1, 0.95, "active"), (2, 0.05, "published")], "fact_id long, confidence double, status string")
    ledger = spark.createDataFrame([(2, "old")], "fact_id long, feedback_key string")
    fb = spark.createDataFrame([(1, "k", "publish"), (1, "k", "publish"), (2, "old", "report"), (2, "new", "report")], "fact_id long, feedback_key string, signal string")
    out, led, history = graph.apply_feedback(facts, ledger, fb)
    assert {tuple(r) for r in out.collect()} == {(1, 1.0, "published"), (2, 0.0, "needs_review")}
    assert led.count() == 3 and history.count() == 2


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame(
        [(True, ["p1"], ["p1", "x"], ["k", "k"], "it is 42", ["42"], ["42"], ["p1"], 10.0, 40.0), (False, [], [], [], "알 수 없습니다", [], [], [], 20.0, 30.0)],
        "answerable boolean, expected_refs array<string>, ranked_refs array<string>, parent_keys array<string>, answer string, accepted array<string>, signatures array<string>, citations array<string>, retrieval_ms double, total_ms double",
    )
    m = evaluate.structure_metrics(rows).first()
    assert (m.recall_at_1, m.mrr, m.answer_accuracy, m.numeric_accuracy, m.citation_accuracy, m.false_positive_rate, m.parent_duplicate_rate, m.p95_total_ms) == (1, 1, 1, 1, 1, 0, 0.5, 40)


def test_diversity_refills(spark):
    rows = spark.createDataFrame([(1, i, i, "s", f"sec{i % 2}") for i in range(1, 9)], "query_id long, id long, rank int, source_path string, section string")
    got = [r.id for r in gates.diversify(rows, 6, 1, 6).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5, 6]


def test_failures_and_progress(spark):
    assert one(spark, ops.by_rules(F.lit("boom"), ops.FAILURES, "x", F.lit("PermissionError")), ops.by_rules(F.lit("PDF and ocr"), ops.FAILURES, "x"), ops.by_rules(F.lit(""), ops.FAILURES, "x")) == ("file_permission_fail", "ocr_inference_fail", "x")
    assert one(spark, ops.progress(F.lit("run_pdf_ocr"), F.lit("processing"), F.lit(0), F.lit(0.5)), ops.progress(F.lit("done"), F.lit("processing"), F.lit(3), F.lit(1.0)), ops.progress(F.lit("?"), F.lit("processing"), F.lit(7), F.lit(1.0))) == (63, 100, 7)


def test_literals_and_codes(spark):
    got = one(spark, retrieval.literals(F.lit('use "Exact Phrase" with api-v2 and code 1234, not 99999')))[0]
    assert got == ["exact phrase", "1234", "api-v2"]
    assert one(spark, retrieval.literal_score(F.lit("x 12345 api-v2"), F.array(F.lit("1234"), F.lit("api-v2"))))[0] == 0.5


def test_rerank_parse_and_columns(spark):
    assert one(spark, gates.rerank_parse(F.lit("3, 1,3,9"), F.lit(4)))[0] == [3, 1, 2, 4]
    left = spark.createDataFrame([("p", 1, 10.0), ("p", 2, 20.0)], "page string, lid long, y double")
    right = spark.createDataFrame([("p", 7, 9.0), ("p", 8, 17.0), ("p", 9, 30.0), ("p", 6, 1.0)], "page string, rid long, y double")
    assert {(r.lid, r.rid) for r in layout.pair_columns(left, right, "page", 4.0).collect()} == {(1, 7), (2, 8), (2, 9)}


def test_sheet_tables(spark):
    cells = [(1, 1, "Title"), (2, 1, "name"), (2, 2, "price"), (3, 1, "a"), (3, 2, "5"), (5, 1, "x"), (5, 3, "y"), (6, 1, "1"), (6, 3, "2")]
    rows = readers.sheet_tables(spark.createDataFrame([("s", *c) for c in cells], "sheet string, row int, col int, value string"), ["sheet"]).orderBy("row").collect()
    assert [(r.row, r.title, r.headers, r["values"]) for r in rows] == [(3, "Title", ["name", "price"], ["a", "5"]), (6, "", ["x", "y"], ["1", "2"])]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "in/b.txt").write_bytes("plain".encode())
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding) for r in readers.read_texts(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": ("한글", "cp949"), "b.txt": ("plain", "utf-8-sig")}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Contents/section0.xml", "<s xmlns='u'><p><t>1. Head</t></p><p><t>body</t></p><tbl><tr><tc><p><t>c1</t></p></tc><tc><p><t>c2</t></p></tc></tr></tbl></s>")
    (tmp_path / "hw").mkdir()
    (tmp_path / "hw/x.zip").write_bytes(buffer.getvalue())
    rows = readers.read_archives(spark, str(tmp_path / "hw")).orderBy("seq").collect()
    assert [(r.kind, r.text, r.row_no, r.cell_no) for r in rows] == [("paragraph", "1. Head", 0, 0), ("paragraph", "body", 0, 0), ("cell", "c1", 1, 1), ("cell", "c2", 1, 2)]
    (tmp_path / "f.jsonl").write_text('{"id": 1, "at": 5}\nbroken\n{"id": 2, "at": 9}\n')
    rows, bad = readers.read_jsonl(spark, str(tmp_path / "f.jsonl"), "id long, at long", "at", 1)
    assert [r.id for r in rows.collect()] == [2] and bad.count() == 1
    log = tmp_path / "log"
    log.write_text("xxxxxxxx")
    assert sinks.rotate(spark, str(log), 4, 2) and (tmp_path / "log.1").exists() and not sinks.rotate(spark, str(log), 4, 2)


def test_markdown(spark):
    none = F.array().cast("array<string>")
    text = one(spark, sinks.markdown({"title": F.lit("T: x"), "n": F.lit(3)}, F.lit("T: x"), F.lit(" Body "), F.array(F.lit("s1")), none))[0]
    assert text == "---\ntitle: T- x\nn: 3\n---\n\n# T: x\n\nBody\n\n## Sources\n- 근거: s1\n"
