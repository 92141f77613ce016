"""Ground-truth bills as rows of text: CSV by Spark's reader, XLSX by a reader of its zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def delimiter(header: str) -> str:
    return ";" if header.count(";") >= header.count(",") else ","


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with row_no in file order within a file; the delimiter is told by the header line."""
    head = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    if not head:
        raise ValueError(f"Facit-filen är tom: {path}")
    rows = spark.read.option("header", True).option("sep", delimiter(head[0][0])).option("encoding", "UTF-8").csv(path)
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def xlsx_rows(raw: bytes) -> list[list[str | None]]:
    """The first sheet's cells as text, by row."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        rows = []
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{_NS}row"):
            cells: list[str | None] = []
            for i, c in enumerate(row.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else i
                cells += [None] * (at - len(cells))
                value = c.find(f"{_NS}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                cells.append(inline or None if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text)
            rows.append(cells)
    return rows


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_xlsx(spark: SparkSession, raw: bytes) -> DataFrame:
    """One bill; a bill is a file of some thousands of rows at most."""
    rows = xlsx_rows(raw)
    if not rows:
        raise ValueError("Facit-filen är tom")
    names = [(c or "").strip() for c in rows[0]]
    keep = [i for i, n in enumerate(names) if n]
    data = [tuple([r[i] if i < len(r) else None for i in keep] + [no]) for no, r in enumerate(rows[1:])]
    return spark.createDataFrame(data, ", ".join(f"`{names[i]}` string" for i in keep) + ", row_no long")
