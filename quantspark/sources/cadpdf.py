"""A Python data source for simple vector PDFs: spark.read.format("cadpdf").option("table", ...).load(folder).

One input partition a file. Reads uncompressed and Flate streams: paths (m l c v y re h), pens (w), stroke colours
(RG G K), transforms (q Q cm), optional-content layers (BDC /OC ... EMC), text (BT Tf Td TD Tm T* Tj TJ ' "). Text boxes
use an average glyph width, as fonts are not rendered. Encrypted files and object streams raise an error: what can't be
read is never passed over silently. Text that is drawn as lines needs an OCR engine: see `ocr`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import schema

_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>%]*|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*][A-Za-z0-9'\"*]*)", re.S)
_GLYPH, _ASCENT, _DESCENT = 0.55, 0.8, 0.2


def _objects(raw: bytes) -> dict[int, bytes]:
    if b"/Encrypt" in raw:
        raise ValueError("encrypted PDF")
    if b"/ObjStm" in raw:
        raise ValueError("PDF with object streams")
    return {int(m[1]): m[2] for m in re.finditer(rb"(?:^|\s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw, re.S)}


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    data = m[1]
    if b"/FlateDecode" in body[: m.start()]:
        data = zlib.decompressobj().decompress(data)
    return data


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _box(body: bytes) -> tuple[float, ...] | None:
    m = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body)
    return tuple(float(x) for x in m[1].split()) if m else None


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    out: list[bytes] = []

    def walk(no: int, seen: frozenset[int]) -> None:
        body = objects.get(no, b"")
        if no in seen:
            return
        if re.search(rb"/Type\s*/Pages\b", body):
            for kid in _refs(body, b"Kids"):
                walk(kid, seen | {no})
        elif body:
            out.append(body)

    for no in _refs(root, b"Pages"):
        walk(no, frozenset())
    return out or [b for b in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", b)]


def _layers(page: bytes, objects: dict[int, bytes]) -> dict[bytes, str]:
    """Layer names by the property names that content streams use."""
    res = page
    for no in _refs(page, b"Resources"):
        res += objects.get(no, b"")
    m = re.search(rb"/Properties\s*<<(.*?)>>", res, re.S)
    out = {}
    for key, no in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", m[1]) if m else []:
        name = re.search(rb"/Name\s*\(((?:\\.|[^\\()])*)\)", objects.get(int(no), b""))
        out[key] = _text(b"(" + name[1] + b")") if name else ""
    return out


def _text(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust(2, "0"))
    else:
        esc = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else esc.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace")


@dataclass
class _State:
    ctm: tuple[float, ...] = (1, 0, 0, 1, 0, 0)
    width: float = 1.0
    color: tuple[float, float, float] | None = (0.0, 0.0, 0.0)
    size: float = 1.0
    leading: float = 0.0


def _times(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


@dataclass
class _Page:
    height: float
    items: list[tuple] = field(default_factory=list)
    words: list[tuple] = field(default_factory=list)

    def at(self, m: tuple[float, ...], x: float, y: float) -> tuple[float, float]:
        return m[0] * x + m[2] * y + m[4], self.height - (m[1] * x + m[3] * y + m[5])


def _interpret(content: bytes, names: dict[bytes, str], page: _Page) -> None:
    """Runs a content stream: fills the page's items and words."""
    st, stack, args, marks = _State(), [], [], []
    path: list[tuple[str, list[float]]] = []
    start = here = (0.0, 0.0)
    tm = line = (1, 0, 0, 1, 0, 0)
    paths = 0

    def add(kind: str, *points: tuple[float, float]) -> None:
        path.append((kind, [v for x, y in points for v in page.at(st.ctm, x, y)]))

    def show(text: str) -> None:
        nonlocal tm
        m, x = _times(tm, st.ctm), 0.0
        for word in re.finditer(r"\S+|\s+", text):
            wide = len(word[0]) * st.size * _GLYPH
            if not word[0].isspace():
                (x0, y0), (x1, y1) = page.at(m, x, -_DESCENT * st.size), page.at(m, x + wide, _ASCENT * st.size)
                page.words.append((word[0], min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))
            x += wide
        tm = _times((1, 0, 0, 1, x, 0), tm)

    pos = 0
    while m := _TOKEN.match(content, pos):
        pos, tok = m.end(), m[1]
        if tok[:1] in b"(<[]/>" or tok[:1].isdigit() or tok[:1] in b"+-.":
            args.append(tok)
            continue
        op, num = tok.decode(), [float(a) for a in args if a[:1].isdigit() or a[:1] in b"+-."]
        if op == "q":
            stack.append(_State(**vars(st)))
        elif op == "Q" and stack:
            st = stack.pop()
        elif op == "cm":
            st.ctm = _times(tuple(num[-6:]), st.ctm)
        elif op == "w":
            st.width = num[-1]
        elif op in ("RG", "G", "K"):
            st.color = tuple(num[-3:]) if op == "RG" else (num[-1],) * 3 if op == "G" else tuple((1 - c) * (1 - num[-1]) for c in num[-4:-1])
        elif op in ("BDC", "BMC"):
            tag = [a[1:] for a in args if a[:1] == b"/"]
            marks.append(names.get(tag[1]) if len(tag) > 1 and tag[0] == b"OC" else None)
        elif op == "EMC" and marks:
            marks.pop()
        elif op == "m":
            start = here = (num[-2], num[-1])
        elif op == "l":
            add("l", here, (num[-2], num[-1]))
            here = (num[-2], num[-1])
        elif op in "cvy" and len(op) == 1:
            p = list(zip(num[0::2], num[1::2], strict=True))
            p = p if op == "c" else [here, *p] if op == "v" else [*p, p[-1]]
            add("c", here, *p)
            here = p[-1]
        elif op == "re":
            x, y, w, h = num[-4:]
            (x0, y0), (x1, y1) = page.at(st.ctm, x, y), page.at(st.ctm, x + w, y + h)
            path.append(("re", [min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)]))
            start = here = (x, y)
        elif op == "h":
            if here != start:
                add("l", here, start)
            here = start
        elif op in ("S", "s", "B", "B*", "b", "b*"):
            if op in ("s", "b", "b*") and here != start:
                add("l", here, start)
            scale = abs(st.ctm[0] * st.ctm[3] - st.ctm[1] * st.ctm[2]) ** 0.5
            layer = next((x for x in reversed(marks) if x), "")
            page.items += [(paths, i, k, c, st.width * scale, *(st.color or (None,) * 3), layer) for i, (k, c) in enumerate(path)]
            paths, path = paths + 1, []
        elif op in ("f", "F", "f*", "n"):
            path = []
        elif op == "BT":
            tm = line = (1, 0, 0, 1, 0, 0)
        elif op == "Tf":
            st.size = num[-1]
        elif op == "TL":
            st.leading = num[-1]
        elif op in ("Td", "TD"):
            st.leading = -num[-1] if op == "TD" else st.leading
            tm = line = _times((1, 0, 0, 1, num[-2], num[-1]), line)
        elif op == "Tm":
            tm = line = tuple(num[-6:])
        elif op in ("T*", "'", '"'):
            tm = line = _times((1, 0, 0, 1, 0, -st.leading), line)
        if op in ("Tj", "TJ", "'", '"'):
            show("".join(_text(a) for a in args if a[:1] in b"(<"))
        args = []


def read_pdf(raw: bytes) -> list[tuple[float, float, _Page]]:
    """(width, height, content) of each page."""
    objects, out = _objects(raw), []
    for body in _pages(objects):
        box = _box(body) or next((b for b in map(_box, objects.values()) if b), (0.0, 0.0, 595.0, 842.0))
        page = _Page(box[3] - box[1])
        content = b"\n".join(_stream(objects.get(n, b"")) for n in _refs(body, b"Contents"))
        _interpret(content, _layers(body, objects), page)
        out.append((box[2] - box[0], page.height, page))
    return out


def rows_of(doc_id: str, raw: bytes, table: str) -> Iterator[tuple]:
    for no, (width, height, page) in enumerate(read_pdf(raw)):
        if table == "pages":
            yield doc_id, no, float(width), float(height)
        elif table == "items":
            for path, seq, kind, coords, pen, r, g, b, layer in page.items:
                yield doc_id, no, path, seq, kind, [float(c) for c in coords], float(pen), r, g, b, layer
        else:
            for seq, (text, x0, y0, x1, y1) in enumerate(page.words):
                yield doc_id, no, seq, text, float(x0), float(y0), float(x1), float(y1), 100.0, "pdftext", None


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.table, self.files = options.get("table", "items"), options["files"].split("\n")

    def partitions(self):
        return [InputPartition(f) for f in self.files if f]

    def read(self, partition):
        from pyarrow import fs

        path = partition.value
        system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with system.open_input_stream(at) as f:
            yield from rows_of(path.rsplit("/", 1)[-1], f.read(), self.table)


class CadPdf(DataSource):
    """Options: table = pages, hits or items; files = paths, one a line."""

    @classmethod
    def name(cls) -> str:
        return "cadpdf"

    def schema(self) -> str:
        return {"pages": schema.PAGES, "hits": schema.HITS, "items": schema.ITEMS}[self.options.get("table", "items")]

    def reader(self, schema):
        return _Reader(self.options)


def read(spark, files: list[str], table: str):
    spark.dataSource.register(CadPdf)
    return spark.read.format("cadpdf").option("table", table).option("files", "\n".join(files)).load()


def tiles(pages, tile_px: int, overlap: float):
    """(page, tx, ty) of overlapping tiles of pages (px_width, px_height): even steps, the last flush with the edge."""
    from pyspark.sql import functions as F

    step = max(1, int(tile_px * (1 - overlap)))

    def starts(size):
        last = F.greatest(size - tile_px, F.lit(0))
        return F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda x: x < last), F.array(last)))

    return pages.select("doc_id", "page_no", F.explode(starts(F.col("px_width"))).alias("tx"), "px_height").select("doc_id", "page_no", "tx", F.explode(starts(F.col("px_height"))).alias("ty"))
