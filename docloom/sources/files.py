"""Files as rows: listing, detection of the document type, decoding."""

from __future__ import annotations

import io
import json
import re
import warnings
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.session import ship

# Extensions, signatures, encodings, messages.
TYPES = {
    "pdf": "pdf", "docx": "word", "md": "markdown", "markdown": "markdown", "xlsx": "excel", "xlsm": "excel",
    "json": "json", "txt": "txt", "text": "txt", "pptx": "slides",
}
LEGACY = {"doc": ("Word", "docx"), "xls": ("Excel", "xlsx"), "ppt": ("PowerPoint", "pptx")}
OLE, ZIP, PDF = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04", b"%PDF"
MEMBERS = {"word/": "word", "xl/": "excel", "ppt/": "slides"}
ENCODINGS, PRINTABLE, HEAD = ("utf-8-sig", "utf-16", "gbk"), 0.8, 4096
FILES = "path string, modificationTime timestamp, length long, content binary"
DETECTED = "struct<document_type:string,detected_by:string,error:string>"


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """binaryFile rows of files, and of the known files right in folders; with file_name, doc_id (its stem) and extension.

    Extensions count in any case of letters.  A path that isn't there is passed by with a warning.
    """
    any_case = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    pattern = "*.{" + ",".join(any_case(e) for e in [*TYPES, *LEGACY]) + "}"
    jvm, out = spark.sparkContext._jvm, None
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            warnings.warn(f"[跳过] 路径不存在: {p}", stacklevel=2)
            continue
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
        rows = (reader.option("pathGlobFilter", pattern) if fs.getFileStatus(at).isDirectory() else reader).load(p)
        out = rows if out is None else out.unionByName(rows)
    return with_names(spark.createDataFrame([], FILES) if out is None else out)


def with_names(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("file_name", name).withColumns(
        {"doc_id": F.regexp_replace("file_name", r"(.)\.[^.]*$", "$1"), "extension": F.lower(F.regexp_extract("file_name", r".\.([^.]*)$", 1))}
    )


def by_extension(extension: Column) -> Column:
    """DETECTED by the extension alone; null where it says nothing."""
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    old = F.create_map(*[F.lit(x) for k, (app, new) in LEGACY.items() for x in (k, f"旧版 {app}(.{k}) 暂不支持，请在 Office 中另存为 .{new} 后上传")])
    none = F.lit(None).cast("string")
    return F.when(F.element_at(known, extension).isNotNull(), F.struct(F.element_at(known, extension).alias("document_type"), F.lit("extension").alias("detected_by"), none.alias("error"))).when(
        F.element_at(old, extension).isNotNull(), F.struct(none.alias("document_type"), none.alias("detected_by"), F.element_at(old, extension).alias("error"))
    )


def decoded(head: bytes, whole: bool) -> str | None:
    """Text of a file's head, if it is mostly printable in one of the encodings.

    A head that ends inside a UTF-8 character is cut back to whole characters.
    """
    if not whole:
        for cut in range(1, 4):
            if head[-cut] & 0xC0 == 0xC0:
                head = head[:-cut] if len(head[-cut:].decode("utf-8", "ignore")) == 0 else head
                break
            if head[-cut] < 0x80:
                break
    for encoding in ENCODINGS:
        try:
            text = head.decode(encoding)
        except UnicodeDecodeError:
            continue
        if text and sum(c.isprintable() or c.isspace() for c in text) / len(text) >= PRINTABLE:
            return text
    return None


def sniffed(content: bytes) -> tuple[str | None, str | None, str | None]:
    """(document_type, detected_by, error) by content."""
    head = content[:HEAD]
    if head.startswith(PDF):
        return "pdf", "content_sniffing:pdf_header", None
    if head.startswith(ZIP):
        try:
            names = zipfile.ZipFile(io.BytesIO(content)).namelist()
        except zipfile.BadZipFile:
            return None, None, "文件是损坏的 ZIP 容器，无法识别为 Office 文档"
        for prefix, kind in MEMBERS.items():
            if any(n.startswith(prefix) for n in names):
                return kind, "content_sniffing:zip_structure", None
        return None, None, "是 ZIP 容器但不是受支持的 Office 文档（docx/xlsx/pptx）"
    if head.startswith(OLE):
        return None, None, "该文件是旧版 Office 复合文档（.doc/.xls/.ppt），请在 Office 中另存为新格式后上传"
    text = decoded(head, len(content) <= HEAD)
    if text is None:
        return None, None, "无法识别文件类型（不是已知的文档/文本格式）"
    kind = "markdown" if re.match(r"#{1,6}\s+\S", text) else "txt"
    if text.lstrip("﻿ \t\r\n")[:1] in ("{", "["):
        try:
            json.loads(content.decode("utf-8-sig", "replace"))
            kind = "json"
        except ValueError:
            pass
    return kind, "content_sniffing:text", None


def _sniff(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sniffed(bytes(c)) for c in content], columns=["document_type", "detected_by", "error"])


def sniff(content: Column) -> Column:
    return F.pandas_udf(_sniff, DETECTED)(content)


def detected(files: DataFrame) -> DataFrame:
    """files with document_type, detected_by and error; the content is looked at only where the extension says nothing."""
    ship(files.sparkSession)
    named = files.withColumn("_d", by_extension(F.col("extension")))
    clear = named.where("_d is not null")
    unclear = named.where("_d is null").withColumn("_d", sniff(F.col("content")))
    return clear.unionByName(unclear).select(*files.columns, "_d.*")


def _as_text(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8-sig", "replace"))


def as_text(content: Column) -> Column:
    """UTF-8 text, with or without a mark at its start; broken bytes are replaced."""
    return F.pandas_udf(_as_text, "string")(content)
