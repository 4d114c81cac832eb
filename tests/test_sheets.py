"""Spreadsheets written here part by part and scanned again."""

from __future__ import annotations

import zipfile

import pytest

from seqloom.sources import sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, strings=(), second=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="urn:r"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="urn:p"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData>{second}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")


ROWS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Note</t></is></c></row>'
    '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>41.0</v></c><c r="D2" t="b"><v>1</v></c></row>'
    '<row r="4"><c r="B4"><f>1+1</f><v>2</v></c><c r="D4" t="e"><v>#N/A</v></c></row>'
    "<row><c t=\"str\"><v>x y</v></c><c><v>1.5E3</v></c></row><row r=\"9\"/>"
)
STRINGS = ("<t>File Name</t>", "<r><t>A</t></r><r><t>ge</t></r><rPh><t>hint</t></rPh>", '<t xml:space="preserve"> p1 </t>')


def test_rows(tmp_path):
    workbook(tmp_path / "a.xlsx", ROWS, STRINGS, '<row r="1"><c r="AB1"><v>7</v></c></row>')
    data = (tmp_path / "a.xlsx").read_bytes()
    assert list(sheets.read_rows(data)) == [["File Name", "Age", None, "Note"], [" p1 ", "41.0", None, "TRUE"], [], [None, "2", None, None], ["x y", "1.5E3"], [], [], [], []]
    assert list(sheets.read_rows(data, "Two")) == list(sheets.read_rows(data, 1)) == [[None] * 27 + ["7"]]
    assert [sheets.column_of(x) for x in ("A1", "Z9", "AA1", "BC20")] == [0, 25, 26, 54]
    with pytest.raises(ValueError, match="no sheet 'Three'; there are One, Two"):
        list(sheets.read_rows(data, "Three"))


def test_scan(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", ROWS, STRINGS)
    (tmp_path / "sub").mkdir()
    many = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>f{i}</t></is></c><c r="B{i}"><v>{i}</v></c></row>' for i in range(2, 9002))
    workbook(tmp_path / "sub" / "b.xlsx", '<row r="1"><c r="A1" t="inlineStr"><is><t>Age</t></is></c><c r="B1" t="inlineStr"><is><t> File Name </t></is></c></row>' + many)
    (tmp_path / "other.txt").write_text("x")
    df = sheets.scan_xlsx(spark, str(tmp_path), "Age int, File Name string")
    assert df.columns == ["file", "row", "Age", "File Name"]
    got = sorted((r.row, r.Age, r["File Name"]) for r in df.collect() if r.file.endswith("a.xlsx"))
    assert got == [(2, 41, " p1 "), (4, 2, None), (5, 1500, "x y")]
    other = [(r.row, r.Age, r["File Name"]) for r in df.where("file LIKE '%b.xlsx'").orderBy("row").collect()]
    assert other == [(i, None, str(i)) for i in range(2, 9002)]
    with pytest.raises(Exception, match="no column 'Gender'"):
        sheets.scan_xlsx(spark, str(tmp_path), "Gender string").collect()
