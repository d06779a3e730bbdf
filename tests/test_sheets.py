import datetime as dt
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from panelloom.sources import sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DAY0 = dt.date(1899, 12, 30)


def letters(k):
    out, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def write_book(path, books, shared=True, epoch=DAY0):
    """books: sheet name -> rows of cells: numbers, texts, dates, None; ("e",) is an error. Style 1 is a date, style 2 one of its own."""
    texts = []

    def cell(r, k, x):
        at = f'r="{letters(k)}{r}"'
        if x is None:
            return ""
        if isinstance(x, tuple):
            return f'<c {at} t="e"><v>#N/A</v></c>'
        if isinstance(x, bool):
            return f'<c {at} t="b"><v>{int(x)}</v></c>'
        if isinstance(x, dt.date):
            return f'<c {at} s="{1 + r % 2}"><v>{(x - epoch).days}</v></c>'
        if isinstance(x, (int, float)):
            return f"<c {at}><v>{x!r}</v></c>"
        if shared:
            texts.append(x)
            return f'<c {at} t="s"><v>{len(texts) - 1}</v></c>'
        return f'<c {at} t="inlineStr"><is><r><t>{escape(x[:1])}</t></r><r><t>{escape(x[1:])}</t></r></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, rows) in enumerate(books.items(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, x) for c, x in enumerate(row))}</row>' for r, row in enumerate(rows, 1) if any(x is not None for x in row))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        one = 'date1904="1"' if epoch != DAY0 else ""
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="r"><workbookPr {one}/><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(books, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k % 2 else ""}worksheets/sheet{k}.xml"/>' for k in range(1, len(books) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>")


def day(k):
    return dt.date(2010, 1, 4) + dt.timedelta(days=k)


@pytest.mark.parametrize("shared,epoch", [(True, DAY0), (False, dt.date(1904, 1, 1))])
def test_cells_and_a_sniffed_schema(spark, tmp_path, shared, epoch):
    write_book(tmp_path / "a b.xlsx", {"One & two": [["day", "x", "note", "note"], [day(0), 1.5, "a<b", None], [], [day(1), 2, None, ("e",), True]], "Empty": []}, shared, epoch)
    write_book(tmp_path / "c.xlsx", {"One & two": [["day"], [day(2)]]})
    cells = sheets.read_sheets(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() == 3
    got = {(r.path.rpartition("/")[2], r.row): (r.sheet, r.position, r.cells) for r in cells.collect()}
    assert got["a b.xlsx", 2] == ("One & two", 0, [str(day(0)), "1.5", "a<b"]) and got["a b.xlsx", 4][2] == [str(day(1)), "2", None, None, "true"] and len(got) == 5
    one = sheets.read_sheets(spark, str(tmp_path / "a b.xlsx"), header="true", sheet="One & two")
    assert one.dtypes == [("day", "date"), ("x", "double"), ("note", "string"), ("note_3", "string"), ("_c4", "string")]
    assert [tuple(r) for r in one.orderBy("day").collect()] == [(day(0), 1.5, "a<b", None, None), (day(1), 2.0, None, None, "true")]


def test_price_blocks(spark, tmp_path):
    names = [f"T{k}" for k in range(11)]
    head = [["title"], [], [], [], ["date", *names, None, *names[:10], "T0", None, "odd", None, *names, None, *names]]
    rows = []
    for i in range(6):
        rows.append([day(i) if i % 2 else f"2010 01{day(i).day:02}", *[10.0 + k + i for k in range(11)], None, *[20.0 + k + i for k in range(11)], None, 5, None, *[1.0 * k + i for k in range(11)], None, *[15.0 + k + i if (k, i) != (3, 2) else "n/a" for k in range(11)]])
    write_book(tmp_path / "data.xlsx", {"s": head + rows + [["no date", *[1.0] * 11]]})
    out = {(r.date, r.instrument): r for r in sheets.price_blocks(sheets.read_sheets(spark, str(tmp_path / "data.xlsx"))).collect()}
    assert len(out) == 66 and out[day(2), "T3"].close is None and out[day(2), "T3"].low == 5.0
    # the second T0 of the second block doesn't count, and T10 has no high
    assert out[day(1), "T0"].high == 21.0 and out[day(1), "T10"].high is None and out[day(4), "T5"].open == 19.0


def test_ticker_sheets(spark, tmp_path):
    head = [["x"]] * 6
    good = [[day(i), 1.0, 2.0, 0.5, 1.5 + i, 100 if i else None] for i in range(12)]
    write_book(tmp_path / "px.xlsx", {"AAA": head + good + [["end", 1, 1, 1, 1, 1], [day(40), 1, 1, 1, "-", 1]], "BBB": head + good[:9], "CCC": head + [r[:5] for r in good], "DDD": []})
    out = sheets.ticker_sheets(sheets.read_sheets(spark, str(tmp_path / "px.xlsx")))
    assert {(r.instrument, r.n, r.v) for r in out.groupBy("instrument").agg(F.count("*").alias("n"), F.count("volume").alias("v")).collect()} == {("AAA", 12, 11), ("CCC", 12, 0)}
    assert out.filter("instrument = 'AAA'").agg(F.max("close")).first()[0] == 12.5


def test_exported_files(spark, tmp_path):
    body = [[None, day(i), 1.0, 2.0, 0.5, 1.0 + i] for i in range(25)]
    write_book(tmp_path / "one.xlsx", {"s": [["Exported"], [None, None, "Name"], [None, "code", "aapl.O "], [None, "Date", "Open"]] + body + [[None, day(60), 1, 1, 1, 0], [None, dt.date(1999, 1, 1), 1, 1, 1, 1]], "t": body})
    write_book(tmp_path / "Xyz.xlsx", {"s": [["no code"]] + body})
    write_book(tmp_path / "few.xlsx", {"s": [["MSFT.OQ"]] + body[:19]})
    write_book(tmp_path / "Missing Data.xlsx", {"s": body})
    out = sheets.exported_files(sheets.read_sheets(spark, str(tmp_path)))
    assert {(r.instrument, r["count"]) for r in out.groupBy("instrument").count().collect()} == {("aapl.O", 25), ("XYZ", 25)}
