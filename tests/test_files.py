"""Spreadsheets with merged cells, notes, dates and faults; table hints, survey lists and nested payloads by hand."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.operators import tables as H
from docloom.sources import readers, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def full_book() -> bytes:
    """Shared strings, a title above the header, a merged column, a date, a boolean, a note."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets><sheet name="S &amp; 1" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="a" Type="{REL}/worksheet" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/_rels/one.xml.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="c" Type="{REL}/comments" Target="../comments1.xml"/></Relationships>')
        z.writestr("xl/comments1.xml", f'<comments {MAIN}><commentList><comment ref="B4"><text><r><t>see </t></r><r><t>below</t></r></text></comment></commentList></comments>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Title</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>when</t></si><si><t> both  rows </t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts count="1"><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        rows = (
            '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row>'
            '<row r="3"><c r="A3" t="s"><v>3</v></c><c r="B3" s="1"><v>45292</v></c><c r="C3" t="b"><v>1</v></c></row><row r="4"><c r="A4"/><c r="B4"><v>2.50</v></c></row><row r="6"><c r="B6"><v>7</v></c></row>'
        )
        z.writestr("xl/worksheets/one.xml", f'<worksheet {MAIN}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells></worksheet>')
    return buffer.getvalue()


def test_workbooks(spark):
    wide = sheets.workbook([("w", [["x"] * 201])])
    many = sheets.workbook([(f"s{k}", []) for k in range(21)])
    files = spark.createDataFrame([("good", full_book()), ("no zip", b"x"), ("wide", wide), ("many", many), ("empty", sheets.workbook([("e", [])]))], "path string, content binary")
    cells = sheets.parse_sheets(files).cache()
    assert {r.path: r.error.split(":")[0] for r in cells.filter("error IS NOT NULL").collect()} == {"no zip": "BadZipFile", "wide": "ValueError", "many": "ValueError"}
    rows = sheets.sheet_rows(cells).orderBy("row").collect()
    assert {(r.path, r.sheet, tuple(r["columns"])) for r in rows} == {("good", "S & 1", ("name", "when", "ColC"))}
    assert [r.row_text for r in rows] == ["Row 3: name=both rows | when=2024-01-01 00:00:00 | ColC=True", "Row 4: name=both rows | when=2.5 [주석:see below] | ColC=", "Row 6: name= | when=7 | ColC="]


def test_tables_printed_as_one_line():
    flat = lambda s: H.flat_rows(s.split())
    assert flat("품목 수량 단가 apple 1 2 pear 3 4 5") == [("품목 수량 단가", "apple 1 2"), ("품목 수량 단가", "pear 3 4 5")]
    assert flat("품목 수량 apple 1 2") == []  # fewer than eight words
    assert flat("a b c d e f g h i j 1 2") == [("", "c d e f g h i j 1 2")]  # a label has eight words at most
    assert flat("one two 1 three four 2 five six 3,000원 40% 5") == [("", "five six 3,000원 40% 5")]  # two figures or more
    assert flat("- - - - - - - 1 2 - 3 4") == []  # a label has letters
    assert flat("x " + " ".join(map(str, range(20)))) == [("", "x " + " ".join(map(str, range(12))))]


def test_table_hints_by_hand(spark):
    page = ["품목 수량", "pear 1개 2", "pear 1개 2", "plain text", "pear 1개 2", "kiwi 3", "plum 1,000 (천원) | x"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(page)] + [(2, 0, None), (2, 1, "  "), (3, 0, "only words")], "doc_id long, line_no int, text string")
    got = {r.doc_id: r for r in H.table_hints(lines, "doc_id").collect()}
    assert set(got) == {1, 3} and got[3].hints == [] and not got[3].needs_ocr
    fact = "표의미: kind=table_row | subject=pear 1개 | aliases=pear 1개 | 품목=pear 1개 | 수량=2"
    assert got[1].hints == ["표헤더: 품목 수량", "표행: pear 1개 2", "표행: 품목 수량 | pear 1개 2", "표행요약: 품목 수량 | pear 1개 2", fact, "표값: 1개", "표행: plum 1,000 (천원) | x", "표값: 1000천원"]
    assert (got[1].n_lines, got[1].numeric, got[1].needs_ocr) == (7, 8, True)


def test_grids_and_surveys(spark):
    grid = [(1, 1, "조사명"), (1, 2, "단가"), (2, 1, "농·축산조사"), (2, 2, "20"), (3, 1, "alone")]
    cells = spark.createDataFrame([("f", r, c, t) for r, c, t in grid] + [("one row", 1, 1, "a"), ("one row", 1, 2, "b")], "path string, row_no int, cell_no int, text string")
    got = {r.row_no: r.hints for r in H.grid_hints(cells, ["path"]).collect()}
    assert got[1] == ["표헤더: 조사명 | 단가"] and set(got) == {1, 2}
    assert got[2][0].startswith("표행요약: 조사명=농·축산조사 | 단가=20천원 | 명칭별칭=농·축산조사, ") and got[2][-1] == "표값: 농·축산조사 단가 20천원"
    listed = spark.createDataFrame([("f", i, t) for i, t in [(1, "수건"), (2, "농·축산조사"), (3, "비고"), (4, "30"), (9, "임·어업조사"), (10, "900")]], "path string, line int, text string")
    (row,) = H.survey_hints(listed, ["path"]).collect()
    assert row.line == 2 and row.hints[0].startswith("표행요약: 답례품=수건 | 조사명=농·축산조사 | 지급단가=30천원 | 명칭별칭=") and row.hints[2] == "표값: 농·축산조사 지급단가 30천원"


def test_nested_payloads(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert H.collect_texts(None) == [] and H.collect_texts("{broken") == [] and H.collect_texts(deep) == []
    assert H.collect_texts('{"a": {"text": " x  y\\n\\n z "}, "scores": ["no"], "b": [["q", 1, null, "x y\\nz"], {"BBox ": "no", "rec_texts": ["r"]}]}') == ["x y\nz", "q", "r"]


def test_json_lines(spark):
    lines = spark.createDataFrame([('{"id": 1, "query": "a"}',), ('[{"id": 2, "query": "b"}, {"id": 2}]',), (" ",), ("# note",), ("nothing",), ('{"id": "x"}',)], "value string")
    got = sorted((str(r.id), str(r.query), str(r.fault)) for r in readers.parse_cases(lines, "id long, query string").collect())
    assert got == [("1", "a", "None"), ("2", "None", "a case needs id and query"), ("2", "b", "duplicate case id"), ("None", "None", "not an object"), ("None", "None", "not an object")]
    assert readers.parse_lines(lines.filter(F.lit(False)), "id long").count() == 0


def outlined(parts) -> bytes:
    """An archive with a namespace, styles and a nested run; parts: (style, text)."""
    buffer = io.BytesIO()
    space = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Contents/header.xml", '<h:head xmlns:h="x"><h:style id="1" name="제목 1"/><h:style id="2" engName="Heading 2"/><h:style id="3" name="개요"/></h:head>')
        body = "".join(f'<hp:p styleIDRef="{s}"><hp:run><hp:t>{t}</hp:t></hp:run></hp:p>' for s, t in parts)
        z.writestr("Contents/section0.xml", f"<hp:sec {space}>{body}</hp:sec>")
        z.writestr("Contents/section1.xml", f'<hp:sec {space}><hp:p><hp:run><hp:t>of its own</hp:t></hp:run></hp:p></hp:sec>')
    return buffer.getvalue()


def test_heading_paths(spark):
    one = [("", "제1장 총칙"), ("", "제2조 조사대상"), ("", "조사대상이란 무엇을 말한다"), ("", "before"), ("", "제 2 절 가"), ("", "다만 아니다"), ("", "제3장 나"), ("", "경우"), ("", "1.1 plain number"), ("", "2.2 another"), ("", "3.3 third"), ("", "4.4 fourth"), ("", "end")]
    two = [("", "no heading"), ("1", "조사 개요"), ("2", "조사 대상"), ("", "body"), ("2", "next"), ("3", "first again"), ("", "제4조 deep"), ("", "end")]
    rows = readers.parse_archives(spark.createDataFrame([("one", outlined(one)), ("two", outlined(two))], "path string, content binary")).collect()
    path = {(r.path, r.text): r.heading_path for r in rows}
    assert path["one", "조사대상이란 무엇을 말한다"] == ["제1장 총칙", "제2조 조사대상"] and path["one", "다만 아니다"] == ["제1장 총칙", "제 2 절 가"]
    assert path["one", "경우"] == ["제3장 나"] and path["one", "end"] == ["제3장 나", "1.1 plain number", "2.2 another", "4.4 fourth"]
    assert path["two", "no heading"] == [] and path["two", "body"] == ["조사 개요", "조사 대상"] and path["two", "next"] == ["조사 개요", "next"] and path["two", "end"] == ["first again", "제4조 deep"]
    assert path["one", "of its own"] == []
    sort = {r.text: (r.sort, r.source) for r in rows}
    assert sort["다만 아니다"] == ("exception", "") and sort["경우"] == ("condition", "") and sort["조사대상이란 무엇을 말한다"] == ("definition", "") and sort["조사 대상"] == ("heading", "style") and sort["제3장 나"] == ("heading", "regex")
