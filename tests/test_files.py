"""Detection, and the zip readers on files made here."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.operators.embedding import embed  # noqa: F401
from docloom.plans import ingest
from docloom.sources import files, ooxml

W = 'xmlns:w="w" xmlns:a="a" xmlns:r="http://r"'
PNG = b"\x89PNG data"


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def docx():
    par = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{par(t)}</w:tc>"
    body = (
        par("安装", "H1") + par("说明文字") + par("参数", "H2")
        + f"<w:tbl><w:tr>{cell('型号')}{cell('值|x')}</w:tr><w:tr>{cell('DA-500')}{cell('1')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl>"
        + par("深", "H4") + '<w:p><w:r><w:drawing><a:blip r:embed="rId1"/></w:drawing></w:r></w:p>'
    )
    styles = "".join(f'<w:style w:styleId="H{n}"><w:name w:val="heading {n}"/></w:style>' for n in (1, 2, 3, 4))
    return packed(**{
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>",
        "word/_rels/document.xml.rels": '<R><Relationship Id="rId1" Target="media/i.png"/></R>',
        "word/media/i.png": PNG,
        "[Content_Types].xml": '<T><Default Extension="png" ContentType="image/png"/></T>',
    })


def xlsx():
    s = lambda r, cells: f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cells) + "</row>"
    rows = s(1, [("A", "商品名称"), ("B", "价格"), ("C", "库存")]) + s(2, [("A", "耳机"), ("B", "199")]) + s(3, [("A", "键盘"), ("C", "007")]) + s(5, [("B", "5")])
    return packed(**{
        "xl/workbook.xml": '<w xmlns:r="http://r"><sheets><sheet name="商品清单" r:id="rId1"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></R>',
        "xl/worksheets/sheet1.xml": f"<s><sheetData>{rows}</sheetData></s>",
    })


def pptx():
    sp = lambda t, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda inner: f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="http://r"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    pic = '<p:pic><p:blipFill><a:blip r:embed="rId9"/></p:blipFill></p:pic>'
    group = f"<p:grpSp>{sp('in a group')}</p:grpSp>"
    return packed(**{
        "ppt/presentation.xml": '<p:p xmlns:p="p" xmlns:r="http://r"><p:sldIdLst><p:sldId id="1" r:id="rId1"/><p:sldId id="2" r:id="rId2"/><p:sldId id="3" r:id="rId3"/></p:sldIdLst></p:p>',
        "ppt/_rels/presentation.xml.rels": "<R>" + "".join(f'<Relationship Id="rId{i}" Target="slides/slide{i}.xml"/>' for i in (1, 2, 3)) + "</R>",
        "ppt/slides/slide1.xml": slide(sp("标题", '<p:ph type="title"/>') + sp("正文") + group),
        "ppt/slides/slide2.xml": slide(sp("第二页") + pic),
        "ppt/slides/slide3.xml": slide(sp("只有标题", '<p:ph type="ctrTitle"/>')),
        "ppt/slides/_rels/slide2.xml.rels": '<R><Relationship Id="rId9" Target="../media/i.png"/></R>',
        "ppt/media/i.png": PNG,
    })


def test_docx_as_markdown():
    text, images = ooxml.docx_markdown(docx(), "d")
    assert text.split("\n") == ["# 安装", "说明文字", "## 参数", "|型号|值\\|x|", "|---|---|", "|DA-500|1|", "深", f"[IMAGE:{images[0][0]}]"]
    assert len(images) == 1 and images[0][1:] == ("png", PNG)


def test_xlsx_rows_keep_their_numbers():
    got = list(ooxml.xlsx_records(xlsx()))
    assert [(s, n) for s, n, _ in got] == [("商品清单", 1), ("商品清单", 2), ("商品清单", 4)]
    assert got[1][2] == [("商品名称", "键盘"), ("库存", "007")]


def test_pptx_slides():
    slides, images = ooxml.pptx_slides(pptx(), "p")
    assert slides == [(1, "标题", "正文"), (2, "第 2 页", f"第二页\n[IMAGE:{images[0][0]}]")]


def test_sniffing():
    kind = lambda b: files.sniffed(b)[:2]
    assert kind(b"%PDF-1.7") == ("pdf", "content_sniffing:pdf_header")
    assert [kind(x)[0] for x in (docx(), xlsx(), pptx())] == ["word", "excel", "slides"]
    assert kind(b"## T\nx")[0] == "markdown" and kind(b"x\n## T")[0] == "txt"
    assert kind(b'\xef\xbb\xbf {"a": 1}')[0] == "json" and kind(b"{ prose")[0] == "txt"
    assert kind(("字" * 3000).encode())[0] == "txt"  # the head ends inside a character
    assert kind("中文文本".encode("gbk"))[0] == "txt"
    for bad in (files.OLE + b"x", bytes(range(256)) * 4, b"PK\x03\x04 no", packed(x="y")):
        assert files.sniffed(bad)[2]


def test_all_formats_to_blocks(spark):
    data = [("/f/a.docx", docx()), ("/f/b.xlsx", xlsx()), ("/f/c.pptx", pptx()), ("/f/d", b"# T\nx"), ("/f/e.docx", b"PK\x03\x04 no")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in data], "path string, content binary")
    cut = ingest.file_blocks(files.detected(files.with_names(df)))
    rows = ingest.block_rows(cut).orderBy("doc_id", "block_seq").collect()
    found = [(r["doc_id"], r["page"], r["section"], r["block_type"]) for r in rows]
    assert ("a", None, "安装 / 参数", "section") in found
    assert ("b", 4, "工作表 商品清单", "table_record") in found
    assert ("c", 2, "第 2 页", "slide") in found and ("d", None, "T", "section") in found
    assert [r["image_ids"] for r in rows if r["doc_id"] == "a"][-1]
    assert cut.where(F.col("doc_id") == "e").first()["error"]
