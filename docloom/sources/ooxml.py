"""Readers of docx, xlsx and pptx files, from their zip parts; one file is one row, and errors are values.

Each reader is a table function over (content): the file's parts come out as rows
in the order of the document.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import hashlib
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.operators.chunking import BLOCK, fit, markdown
from docloom.session import ship

# Image types by media type.
IMAGE_TYPES = {
    "image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/bmp": "bmp",
    "image/tiff": "tiff", "image/x-emf": "emf", "image/x-wmf": "wmf", "image/svg+xml": "svg",
}
HEADINGS = {f"{name} {n}": n for n in (1, 2, 3) for name in ("heading", "标题")}
IMAGES = "array<struct<image_id:string,ext:string,data:binary>>"


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


class Package:
    """The parts of a file, their relations and their media types."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self.kinds: dict[str, str] = {}
        if "[Content_Types].xml" in self.names:
            for e in self.xml("[Content_Types].xml"):
                self.kinds[(e.get("Extension") or e.get("PartName") or "").lower()] = e.get("ContentType") or ""

    def xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def relations(self, name: str) -> dict[str, str]:
        """Relation id to part name."""
        path = posixpath.join(posixpath.dirname(name), "_rels", posixpath.basename(name) + ".rels")
        if path not in self.names:
            return {}
        base = posixpath.dirname(name)
        return {e.get("Id"): posixpath.normpath(posixpath.join(base, e.get("Target"))).lstrip("/") if not e.get("Target", "").startswith("/") else e.get("Target")[1:] for e in self.xml(path)}

    def image(self, name: str, stem: str) -> tuple[str, str, bytes] | None:
        """(image_id, ext, data) of a part; None if it is not there."""
        if name not in self.names or not (data := self.zip.read(name)):
            return None
        ext = IMAGE_TYPES.get((self.kinds.get("/" + name.lower()) or self.kinds.get(name.rpartition(".")[2].lower()) or "").lower())
        ext = ext or ("jpg" if data.startswith(b"\xff\xd8") else "png")
        return f"{stem}-{hashlib.md5(data).hexdigest()[:10]}", ext, data


def docx_markdown(content: bytes, stem: str) -> tuple[str, list[tuple]]:
    """The body as Markdown lines, in order: headings to level 3, paragraphs, image marks, tables; and the images, each once."""
    p = Package(content)
    main = "word/document.xml"
    links, styles, lines, images = p.relations(main), {}, [], {}
    if "word/styles.xml" in p.names:
        for s in p.xml("word/styles.xml"):
            if _local(s) == "style":
                styles[_attr(s, "styleId")] = next((_attr(n, "val") or "" for n in s if _local(n) == "name"), "")

    def text(e) -> str:
        out = []
        for x in e.iter():
            out.append({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_local(x), "") if _local(x) != "tab" or x.attrib == {} else "")
        return "".join(out)

    body = next(e for e in p.xml(main) if _local(e) == "body")
    for e in body:
        if _local(e) == "p":
            style = next((_attr(x, "val") for x in e.iter() if _local(x) == "pStyle"), None)
            level = HEADINGS.get(styles.get(style, style or "").lower())
            words = text(e).strip()
            if words:
                lines.append(f"{'#' * level} {words}" if level else words)
            for blip in (x for x in e.iter() if _local(x) == "blip"):
                link = _attr(blip, "embed") or _attr(blip, "link")
                if link in links and (found := p.image(links[link], stem)):
                    lines.append(f"[IMAGE:{found[0]}]")
                    images.setdefault(found[0], found)
        elif _local(e) == "tbl":
            rows = []
            for tr in (x for x in e if _local(x) == "tr"):
                cells = ["\n".join(text(par) for par in tc.iter() if _local(par) == "p") for tc in tr if _local(tc) == "tc"]
                rows.append([c.replace("\n", " ").replace("|", "\\|").strip() for c in cells])
            rows = [r for r in rows if any(r)]
            for n, r in enumerate(rows):
                lines.append(f"|{'|'.join(r)}|")
                if n == 0:
                    lines.append(f"|{'|'.join(['---'] * len(r))}|")
    return "\n".join(lines), list(images.values())


def pptx_slides(content: bytes, stem: str) -> tuple[list[tuple], list[tuple]]:
    """(page, title, text) of the slides with a body, in order; pictures leave marks, grouped shapes are passed by."""
    p = Package(content)
    main = "ppt/presentation.xml"
    links, slides, images = p.relations(main), [], {}
    ids = [_attr_r(e) for e in p.xml(main).iter() if _local(e) == "sldId"]
    for page, name in enumerate((links[i] for i in ids if i in links), 1):
        own, title, parts = p.relations(name), None, []
        tree = next(e for e in p.xml(name).iter() if _local(e) == "spTree")
        for shape in tree:
            kind = _local(shape)
            if kind == "pic":
                link = next((_attr(x, "embed") for x in shape.iter() if _local(x) == "blip"), None)
                if link in own and (found := p.image(own[link], stem)):
                    parts.append(f"[IMAGE:{found[0]}]")
                    images.setdefault(found[0], found)
            elif kind == "sp":
                body = next((x for x in shape if _local(x) == "txBody"), None)
                if body is None:
                    continue
                words = "\n".join("".join((t.text or "") if _local(t) == "t" else "\n" for t in par.iter() if _local(t) in ("t", "br")) for par in body if _local(par) == "p").strip()
                place = next((x for x in shape.iter() if _local(x) == "ph"), None)
                if place is not None and place.get("type") in ("title", "ctrTitle") and title is None:
                    title = words or None
                elif words:
                    parts.append(words)
        if "\n".join(parts).strip():
            slides.append((page, title or f"第 {page} 页", "\n".join(parts)))
    return slides, list(images.values())


def _attr_r(e) -> str | None:
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), None)


def xlsx_records(content: bytes) -> Iterator[tuple[str, int, list[tuple[str, str]]]]:
    """(sheet, row number from 1 under the header, cells as (column, text)) of the rows that hold something."""
    p = Package(content)
    links, shared = p.relations("xl/workbook.xml"), []
    if "xl/sharedStrings.xml" in p.names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in p.xml("xl/sharedStrings.xml")]
    for sheet in (e for e in p.xml("xl/workbook.xml").iter() if _local(e) == "sheet"):
        header: dict[int, str] = {}
        first = None
        for row in (e for e in p.xml(links[_attr_r(sheet)]).iter() if _local(e) == "row"):
            cells = {}
            for n, c in enumerate(x for x in row if _local(x) == "c"):
                at = n
                if ref := re.match(r"[A-Z]+", c.get("r") or ""):
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[0]))) - 1
                value = next((x.text for x in c if _local(x) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                elif c.get("t") == "b" and value is not None:
                    value = "True" if value == "1" else "False"
                if value is not None and value.strip():
                    cells[at] = value.strip()
            number = int(row.get("r") or 0)
            if first is None:
                first, header = number, cells
                continue
            if cells:
                yield sheet.get("name") or "", number - first, [(header.get(i, f"Unnamed: {i}"), v) for i, v in sorted(cells.items())]


def _safe(run):
    """A pandas UDF body whose failures become an error of the row."""

    def one(*args):
        try:
            return (None, *run(*args))
        except Exception as e:  # a broken file must not end the job
            return (f"{type(e).__name__}: {e}", None, None)

    return one


def _images(found) -> list[dict] | None:
    return None if found is None else [dict(zip(("image_id", "ext", "data"), x)) for x in found]


TYPE_docx = f"struct<error:string,markdown:string,images:{IMAGES}>"


def _read_docx(content: pd.Series, stem: pd.Series) -> pd.DataFrame:
    rows = [_safe(docx_markdown)(bytes(c), s) for c, s in zip(content, stem)]
    return pd.DataFrame([(e, m, _images(i)) for e, m, i in rows], columns=["error", "markdown", "images"])


TYPE_pptx = f"struct<error:string,slides:array<struct<page:int,title:string,text:string>>,images:{IMAGES}>"


def _read_pptx(content: pd.Series, stem: pd.Series) -> pd.DataFrame:
    rows = [_safe(pptx_slides)(bytes(c), s) for c, s in zip(content, stem)]
    return pd.DataFrame([(e, None if s is None else [dict(zip(("page", "title", "text"), x)) for x in s], _images(i)) for e, s, i in rows], columns=["error", "slides", "images"])


TYPE_xlsx = "struct<error:string,records:array<struct<sheet:string,row:int,text:string>>>"


def _read_xlsx(content: pd.Series) -> pd.DataFrame:
    def run(data):
        return [{"sheet": s, "row": n, "text": "；".join(f"{k}：{v}" for k, v in cells)} for s, n, cells in xlsx_records(data)], None

    rows = [_safe(run)(bytes(c)) for c in content]
    return pd.DataFrame([(e, r) for e, r, _ in rows], columns=["error", "records"])


def paged_blocks(items: Column, section, page, kind: str) -> Column:
    """array<struct<page, b: block>> of items, each cut where it is too long."""
    block = lambda i, t: F.struct(page(i).alias("page"), F.struct(section(i).alias("section"), F.lit(kind).alias("block_type"), t.alias("text")).alias("b"))
    return F.flatten(F.transform(items, lambda i: F.transform(fit(i["text"]), lambda t: block(i, t))))


def office_blocks(files: DataFrame, kind: str) -> DataFrame:
    """files (content, doc_id) with error, images and blocks: array<struct<page, b>>."""
    ship(files.sparkSession)
    none = F.lit(None).cast(IMAGES)
    if kind == "word":
        rows = files.withColumn("_r", F.pandas_udf(_read_docx, TYPE_docx)("content", "doc_id"))
        found = F.transform(markdown(F.col("_r.markdown")), lambda b: F.struct(F.lit(None).cast("int").alias("page"), b.alias("b")))
        images = F.col("_r.images")
    elif kind == "slides":
        rows = files.withColumn("_r", F.pandas_udf(_read_pptx, TYPE_pptx)("content", "doc_id"))
        found = paged_blocks(F.col("_r.slides"), lambda i: i["title"], lambda i: i["page"], "slide")
        images = F.col("_r.images")
    else:
        rows = files.withColumn("_r", F.pandas_udf(_read_xlsx, TYPE_xlsx)("content"))
        found = paged_blocks(F.col("_r.records"), lambda i: F.concat(F.lit("工作表 "), i["sheet"]), lambda i: i["row"], "table_record")
        images = none
    return rows.withColumns({"error": F.coalesce("error", "_r.error") if "error" in files.columns else F.col("_r.error"), "images": images, "blocks": found}).drop("_r")


BLOCKS = f"array<struct<page:int,b:{BLOCK[6:-1]}>>"
