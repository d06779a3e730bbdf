"""Spreadsheets as a Spark data source: zipped sheet XML, a partition a sheet; and the three layouts that prices come in."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

#: Rows looked at to tell the types of a sheet's columns.
SNIFFED = 100
#: Day 0 of the two date systems, and the number formats that are dates whatever the language.
EPOCHS = {False: dt.date(1899, 12, 30), True: dt.date(1904, 1, 1)}
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _open(path: str):
    """A file of any store that pyarrow reads, to be read from any place in it."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def _files(path: str) -> list[str]:
    """The path, or in a folder all its .xlsx files, by name."""
    from pyarrow import fs

    head = path.partition("://")[0] + "://" if "://" in path else ""
    store, inner = fs.FileSystem.from_uri(path) if head or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = sorted(x.path for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file and x.base_name.lower().endswith(".xlsx") and not x.base_name.startswith("~$"))
    return [path.rstrip("/") + "/" + x.rpartition("/")[2] for x in found]


class Book:
    """A workbook's sheets by name, and what its cells refer to. Rows are read one after the other, whatever their number."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(_open(path))
        names = set(self.zip.namelist())
        targets = {x.get("Id"): x.get("Target") for x in self._tree("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
        book = self._tree("xl/workbook.xml")
        self.epoch = EPOCHS[any(_local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book)]
        self.sheets: dict[str, str] = {}
        for x in book.iter():
            if _local(x.tag) == "sheet":
                target = targets.get(next((v for k, v in x.attrib.items() if _local(k) == "id"), None), "")
                self.sheets[x.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()
        self.has_strings = "xl/sharedStrings.xml" in names

    def _tree(self, name: str) -> ElementTree.Element:
        with self.zip.open(name) as f:
            return ElementTree.parse(f).getroot()

    def _date_styles(self) -> set[int]:
        """The cell styles whose number format is a date."""
        own, out = {}, set()
        for x in self._tree("xl/styles.xml"):
            if _local(x.tag) == "numFmts":
                own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in x}
            elif _local(x.tag) == "cellXfs":
                kinds = [int(f.get("numFmtId", 0)) for f in x]
                out = {k for k, fmt in enumerate(kinds) if fmt in DATE_FORMATS or re.search("[ymdYMD]", own.get(fmt, ""))}
        return out

    def strings(self) -> list[str]:
        """The shared strings: as many as the file has different texts."""
        out = []
        if self.has_strings:
            with self.zip.open("xl/sharedStrings.xml") as f:
                for _, x in ElementTree.iterparse(f):
                    if _local(x.tag) == "si":
                        out.append("".join(t.text or "" for t in x.iter() if _local(t.tag) == "t"))
                        x.clear()
        return out

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """Each row's number and its cells as texts from the first column on: numbers as they stand, dates as ISO dates, errors as nulls."""
        strings, before = self.strings(), 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, x in ElementTree.iterparse(f):
                if _local(x.tag) != "row":
                    continue
                before = int(x.get("r") or before + 1)
                cells: list[str | None] = []
                for c in x:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self._text(c, strings)
                yield before, cells
                x.clear()

    def _text(self, c: ElementTree.Element, strings: list[str]) -> str | None:
        kind, value = c.get("t", "n"), next((v.text for v in c if _local(v.tag) == "v"), None)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
        if value is None or kind == "e":
            return None
        if kind == "s":
            return strings[int(value)]
        if kind == "n" and int(c.get("s", 0)) in self.dates:
            return (self.epoch + dt.timedelta(days=int(float(value)))).isoformat()
        return {"0": "false", "1": "true"}.get(value, value) if kind == "b" else value


def _column(reference: str) -> int:
    """The place of a cell's column, from 0."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _number(x: str | None) -> float | None:
    try:
        return float(x) if x not in (None, "") else None
    except ValueError:
        return None


def _day(x: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat(x[:10]) if x else None
    except ValueError:
        return None


def sniff(rows: list[tuple[int, list[str | None]]]) -> StructType:
    """Column names of the first row, and double, date or string by what stands below; repeated or missing names get their place."""
    header = rows[0][1] if rows else []
    width, fields, seen = max((len(c) for _, c in rows), default=0), [], set()
    for k in range(width):
        name = (header[k] if k < len(header) else None) or f"_c{k}"
        name = name if name not in seen else f"{name}_{k}"
        seen.add(name)
        below = [c[k] for _, c in rows[1:] if k < len(c) and c[k] not in (None, "")]
        kind = DoubleType() if below and all(_number(x) is not None for x in below) else DateType() if below and all(_day(x) for x in below) else StringType()
        fields.append(StructField(name, kind))
    return StructType(fields)


@dataclass
class SheetPart(InputPartition):
    path: str
    sheet: str
    position: int


class SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.header, self.schema = options["path"], options.get("header", "false").lower() == "true", schema
        self.wanted = options.get("sheet")

    def partitions(self) -> list[SheetPart]:
        return [SheetPart(f, name, k) for f in _files(self.path) for k, name in enumerate(Book(f).sheets) if self.wanted in (None, name)]

    def read(self, partition: SheetPart) -> Iterator[tuple]:
        rows = Book(partition.path).rows(partition.sheet)
        if not self.header:
            for number, cells in rows:
                yield partition.path, partition.sheet, partition.position, number, cells
            return
        make = {"double": _number, "date": _day}
        kinds = [make.get(f.dataType.simpleString(), lambda x: x) for f in self.schema.fields]
        for _, cells in islice(rows, 1, None):
            if any(c not in (None, "") for c in cells):
                yield tuple(f(cells[k]) if k < len(cells) else None for k, f in enumerate(kinds))


class Sheets(DataSource):
    """spark.read.format("sheets").load(path): path, sheet, position (of the sheet, from 0), row (from 1) and cells, an array of texts.

    The path is a workbook or a folder of them. A sheet is a partition. With header=true the first row of the first sheet names the
    columns, whose types are sniffed; option sheet reads the sheets of that name only. An empty sheet has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str | StructType:
        if self.options.get("header", "false").lower() != "true":
            return "path string, sheet string, position int, row int, cells array<string>"
        for part in SheetReader(self.options, StructType()).partitions():
            return sniff(list(islice(Book(part.path).rows(part.sheet), SNIFFED + 1)))
        return StructType()

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(self.options, schema)


def read_sheets(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(Sheets)
    return spark.read.format("sheets").options(**options).load(path)


# ---------------------------------------------------------------- layouts

_cell = lambda k: F.try_element_at("cells", F.lit(k + 1))


def _date(x: Column) -> Column:
    """A date from an ISO text, eight digits, or a day number."""
    text = F.regexp_replace(x, r"\s+", "")
    return F.coalesce(F.try_to_timestamp(F.substring(x, 1, 10), F.lit("yyyy-MM-dd")).cast("date"), F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")), F.when(text.rlike(r"^\d{5}(\.\d+)?$"), F.date_add(F.lit(str(EPOCHS[False])).cast("date"), text.cast("double").cast("int"))))


def price_blocks(cells: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close"), least_width: int = 10, header: int = 5) -> DataFrame:
    """date, instrument and the fields, of a sheet with a block of columns a field: dates in the first column, tickers in row `header`.

    Blocks are runs of at least `least_width` columns that are not wholly empty; the first len(fields) count. Of a ticker that
    repeats in a block the first column counts. Only the table of a sheet's columns is numbered in one window; values are one long pass.
    """
    long = cells.filter("position = 0").select("row", _date(_cell(0)).alias("date"), F.posexplode("cells").alias("pos", "x")).filter("pos > 0 and x is not null and x != ''")
    used = long.groupBy("pos").agg(F.max(F.when(F.col("row") == header, F.trim("x"))).alias("instrument"))
    # one row a column of the sheet
    run = F.col("pos") - F.row_number().over(Window.orderBy("pos"))
    used = used.withColumn("_run", run).withColumn("_n", F.count("*").over(Window.partitionBy("_run"))).filter(F.col("_n") >= least_width)
    used = used.withColumn("block", F.dense_rank().over(Window.orderBy("_run"))).filter((F.col("block") <= len(fields)) & F.col("instrument").isNotNull() & (F.col("instrument") != ""))
    used = used.withColumn("_first", F.row_number().over(Window.partitionBy("block", "instrument").orderBy("pos"))).filter("_first = 1")
    field = F.element_at(F.array(*map(F.lit, fields)), F.col("block"))
    rows = long.filter((F.col("row") > header) & F.col("date").isNotNull()).join(F.broadcast(used.select("pos", "instrument", field.alias("field"))), "pos")
    rows = rows.withColumn("x", F.col("x").try_cast("double")).filter("x is not null")
    return rows.groupBy("date", "instrument").pivot("field", list(fields)).agg(F.max_by("x", "row"))


def ticker_sheets(cells: DataFrame, skip: int = 6, least: int = 10) -> DataFrame:
    """instrument, date, open, high, low, close, volume, of workbooks with a sheet an instrument, named after it, below `skip` rows of header.

    Rows without a date or close go, and so do sheets with fewer than `least` closes.
    """
    names = ("open", "high", "low", "close", "volume")
    rows = cells.filter(F.col("row") > skip).select("path", F.col("sheet").alias("instrument"), _date(_cell(0)).alias("date"), *[_cell(k).try_cast("double").alias(c) for k, c in enumerate(names, 1)])
    rows = rows.filter("date is not null and close is not null")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("path", "instrument"))).filter(F.col("_n") >= least).drop("_n", "path")


def exported_files(cells: DataFrame, since: str = "2000-01-01", least: int = 20) -> DataFrame:
    """date, instrument, open, high, low, close, of workbooks with one instrument each: its code in the header, dates in the second column.

    The code is the first of the first ten rows and five columns that has a point and ends in a venue (.O, .N, .A, .OQ); without
    one it is the file's name. Data begins at the first row with a date; closes that are missing or not above 0 go, and so do files
    with fewer than `least` rows.
    """
    first = cells.filter("position = 0")
    code = F.try_element_at(F.filter(F.slice("cells", 1, 5), lambda x: F.upper(x).rlike(r"\.(O|N|A|OQ)\s*$")), F.lit(1))
    codes = first.filter("row <= 10").groupBy("path").agg(F.min_by(F.trim(code), F.when(code.isNotNull(), F.col("row"))).alias("code"))
    rows = first.select("path", _date(_cell(1)).alias("date"), *[_cell(k).try_cast("double").alias(c) for k, c in enumerate(("open", "high", "low", "close"), 2)])
    rows = rows.filter((F.col("date") >= F.lit(since).cast("date")) & (F.col("close") > 0))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("path"))).filter(F.col("_n") >= least)
    stem = F.upper(F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), r"%20|\s", ""))
    out = rows.join(codes, "path").withColumn("instrument", F.coalesce("code", F.when((stem != "") & (stem != "MISSINGDATA"), stem))).filter("instrument is not null")
    return out.select("date", "instrument", "open", "high", "low", "close")
