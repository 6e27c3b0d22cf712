import io
import zipfile

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import workforce_signals as ws
from driver_queries.fixtures import _BOOK, _workbook
from workforce_signals.sources import workbook

SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(sheet, strings="", styles="", properties="", more=""):
    """A workbook from the inside of its sheet."""
    names = f'<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/>{more}</sheets></workbook>'
    parts = _BOOK | {
        "xl/workbook.xml": _BOOK["xl/workbook.xml"].split("<sheets>")[0] + properties + names,
        "xl/worksheets/sheet1.xml": f"<worksheet {SPACE}><sheetData>{sheet}</sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": f"<worksheet {SPACE}><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>",
    }
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace(
        "</Relationships>", '<Relationship Id="rId9" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
    )
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst {SPACE}>{strings}</sst>"
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet {SPACE}>{styles}</styleSheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def cells(content, sheet=0):
    return list(workbook.Workbook(content).rows(sheet))


def test_kinds_of_cells():
    strings = "<si><t xml:space='preserve'> a &amp; b </t></si><si><r><t>x</t></r><r><t>y_x000D_z</t></r><rPh><t>aid</t></rPh></si><si><t/></si>"
    styles = (
        '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    )
    sheet = (
        '<row r="1"/><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c><c t="inlineStr"><is><t>in</t></is></c></row>'
        "<row><c><v>12</v></c><c><v>1.50</v></c><c><v>1E3</v></c><c><v>-0.1</v></c><c><v>12345678901234567890</v></c></row>"
        '<row><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>f</v></c><c t="d"><v>2020-01-02</v></c></row>'
        '<row><c s="1"><v>43831</v></c><c s="2"><v>43831.5</v></c><c s="3"><v>43831</v></c><c s="1" t="s"><v>0</v></c></row>'
        '<row><c r="B6"><v>1</v></c><c r="AA6"><v>2</v></c><c><v>3</v></c></row><row><c/><c t="e"><v>#REF!</v></c></row>'
    )
    found = cells(book(sheet, strings, styles))
    assert found[0] == [" a & b ", "xy\rz", None, "in"]
    assert found[1] == ["12", "1.5", "1000", "-0.1", "1.2345678901234567e+19"]
    assert found[2] == ["true", None, "f", "2020-01-02"]
    assert found[3] == ["2020-01-01", "2020-01-01 12:00:00", "43831", " a & b "]
    assert found[4] == [None, "1", *[None] * 24, "2", "3"]
    assert len(found) == 5  # rows without a value are no rows
    assert cells(book('<row><c s="1"><v>1</v></c></row>', styles=styles, properties='<workbookPr date1904="1"/>')) == [["1904-01-02"]]


def test_sheets_go_by_name_or_place():
    content = book("<row><c><v>1</v></c></row>", more='<sheet name="2020" sheetId="2" r:id="rId9"/>')
    assert cells(content) == cells(content, "Sheet1") == [["1"]]
    assert cells(content, 1) == cells(content, "2020") == [["7"]]
    for wrong in (2, "other"):
        with pytest.raises(ValueError, match="no sheet"):
            cells(content, wrong)


def test_headers():
    assert workbook._headers(iter([["a", None, "a", "a"], [None] * 5 + ["x"]])) == ["a", "Unnamed: 1", "a.1", "a.2", "Unnamed: 4", "Unnamed: 5"]
    assert workbook._headers(iter([])) == []


@settings(max_examples=50, deadline=None)
@given(
    st.lists(
        st.lists(
            st.one_of(st.none(), st.integers(-(10**15), 10**15), st.floats(allow_nan=False, allow_infinity=False), st.text(st.characters(codec="utf-8", exclude_categories=("Cc", "Cs"), exclude_characters="_￾￿"))),
            min_size=3,
            max_size=3,
        )
    )
)
def test_round_trip(values):
    found = [r[1:] for r in cells(_workbook([("a", "b", "c"), *map(tuple, values)]))[1:]]

    def text(v):
        return None if v is None or v == "" else v if isinstance(v, str) else workbook._number(repr(v))

    assert [row + [None] * (3 - len(row)) for row in found] == [[text(v) for v in row] for row in values]


def test_link_table_from_workbooks(spark, tmp_path):
    parts = [[("ID", "NAME", "GVKEY"), (1, "Ärger & Co", "001"), (None, None, "999")], [("GVKEY", "Extra", "ID", "NAME"), (12, "e", 2.0, "B")]]
    for i, part in enumerate(parts):
        (tmp_path / f"{i}.xlsx").write_bytes(_workbook(part))
    (tmp_path / "empty.xlsx").write_bytes(book(""))
    found = ws.read_link(spark, f"{tmp_path}/*.xlsx", index_col=0)
    assert dict(found.dtypes) == {"ID": "double", "NAME": "string", "GVKEY": "string", "Extra": "string"}
    assert rows(found, "ID", "NAME", "GVKEY", "Extra") == [(None, None, "999", None), (1.0, "Ärger & Co", "001", None), (2.0, "B", "12", "e")]
    assert rows(ws.read_table(spark, f"{tmp_path}/0"), "GVKEY") == [("001",), ("999",)]
    with pytest.raises(FileNotFoundError, match="no workbook"):
        ws.read_link(spark, f"{tmp_path}/empty.xlsx")


def test_rows_after_the_first_batch(spark, tmp_path, monkeypatch):
    (tmp_path / "t.xlsx").write_bytes(_workbook([("ID", "NAME", "GVKEY"), *((i, f"n{i}", "g") for i in range(25_000))]))
    found = ws.read_link(spark, f"{tmp_path}/t.xlsx", index_col=0)
    assert found.count() == 25_000 and found.agg({"ID": "sum"}).first()[0] == 24_999 * 12_500
