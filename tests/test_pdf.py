"""The PDF reader on files made here."""

import zlib

from docloom.operators import store
from docloom.plans import ingest
from docloom.sources import files, pdf


def made(*contents, extra=b"", compressed=False, resources=b"/Font << /F1 5 0 R >> /XObject << /I1 6 0 R >>"):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents))) + b"] /Count %d /MediaBox [0 0 600 800] >>" % len(contents),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [" + b"500 " * 95 + b"] /Encoding << /Differences [1 /fi /uni4E2D] >> >>",
        6: b"<< /Type /XObject /Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Length 6 >>\nstream\nabcdef\nendstream",
    }
    for i, c in enumerate(contents):
        body = zlib.compress(c) if compressed else c
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << " + resources + b" >> /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if compressed else b"", body)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + extra + b"trailer << /Root 1 0 R >>\n"


def text(x, y, s, size=10):
    return b"BT /F1 %d Tf %d %d Td (%s) Tj ET\n" % (size, x, y, s)


def test_text_lines_blocks_and_gaps():
    page = text(50, 700, b"Hello") + text(50, 688, b"wor\\(l\\)d") + b"BT /F1 10 Tf 50 500 Td [(A) -900 (B) -100 (C)] TJ ET " + text(50, 300, b"\\001x\\002")
    for compressed in (False, True):
        [(n, height, plain, items)], images = pdf.read(made(page, compressed=compressed), "d")
        assert (n, height, images) == (1, 800.0, [])
        lines = [["".join(s[0] for s in line) for line in i[5]] for i in items]
        assert lines == [["Hello", "wor(l)d"], ["ABC"], ["fix中"]]
        assert items[0][1:5] == (50.0, 90.0, 85.0, 112.0) and "Hello" in plain


def test_ruled_table_and_image():
    grid = b"".join(b"100 %d m 300 %d l S\n" % (y, y) for y in (600, 580, 560)) + b"".join(b"%d 560 m %d 600 l S\n" % (x, x) for x in (100, 200, 300))
    page = grid + text(110, 585, b"k") + text(210, 585, b"v") + text(110, 565, b"1") + b"q 50 0 0 20 10 30 cm /I1 Do Q"
    [(_, _, _, items)], images = pdf.read(made(page), "d")
    kinds = {i[0]: i for i in items}
    assert kinds["table"][6] == [["k", "v"], ["1", None]] and kinds["table"][1:5] == (100.0, 200.0, 300.0, 240.0)
    assert kinds["image"][1:5] == (10.0, 750.0, 60.0, 770.0) and kinds["image"][7] == images[0][0] and images[0][2].startswith(b"\x89PNG")


def test_unicode_map_of_a_composite_font():
    cmap = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    extra = (
        b"7 0 obj << /Subtype /Type0 /DescendantFonts [8 0 R] /ToUnicode 9 0 R >> endobj\n8 0 obj << /DW 1000 /W [1 [500]] >> endobj\n"
        + b"9 0 obj << /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    )
    page = b"BT /F2 10 Tf 10 10 Td <000100020004FFFF> Tj ET"
    [(_, _, plain, items)], _ = pdf.read(made(page, extra=extra, resources=b"/Font << /F2 7 0 R >>"), "d")
    assert plain == "中ac�" and items[0][3] == 10.0 + 5 + 30


def test_pdf_to_blocks_with_a_chained_table(spark):
    def grid(top, rows):
        ys = [top - 20 * i for i in range(len(rows) + 1)]
        lines = b"".join(b"100 %d m 300 %d l S\n" % (y, y) for y in ys) + b"".join(b"%d %d m %d %d l S\n" % (x, ys[-1], x, ys[0]) for x in (100, 200, 300))
        return lines + b"".join(text(105 + 100 * j, ys[i] - 15, c) for i, r in enumerate(rows) for j, c in enumerate(r))

    one = text(50, 700, b"Intro") + grid(100, [[b"h", b"k"], [b"1", b"2"]])
    two = grid(790, [[b"3", b"4"], [b"5", b"6"]]) + text(50, 400, b"After") + text(300, 20, b"2")
    data = [("/f/a.pdf", made(one, two)), ("/f/bad.pdf", b"%PDF-1.4 nothing"), ("/f/locked.pdf", made(one) + b"trailer << /Encrypt 1 0 R >>")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in data], "path string, content binary")
    cut = ingest.file_blocks(files.detected(files.with_names(df)))
    rows = [(r["page"], r["block_type"], r["text"]) for r in ingest.block_rows(cut).where("doc_id = 'a'").orderBy("block_seq").collect()]
    assert rows == [(1, "page", "Intro"), (1, "table", "h | k\n1 | 2\n3 | 4\n5 | 6"), (2, "page", "After")]
    errors = {r["doc_id"]: r["error"] for r in cut.collect()}
    assert errors["a"] is None and errors["bad"] and "加密" in errors["locked"]
    pages = pdf.judged(pdf.page_rows(pdf.with_pages(files.with_names(df).where("path like '%a.pdf'")))).orderBy("page").collect()
    assert [(r["verdict"], r["tables"]) for r in pages] == [("红", 1), ("红", 1)]


def test_report_holds_page_quality_and_images(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = tmp_path / "in"
    folder.mkdir()
    page = text(50, 700, b"Enough words on this page to be over the least count of characters, so that it is green or so.") + b"q 50 0 0 20 10 30 cm /I1 Do Q"
    (folder / "a.pdf").write_bytes(made(page, text(10, 10, b"x")))
    now = F.lit("2026-01-01").cast("timestamp")
    for saved in (1, 0):
        r = ingest.ingest(spark, [str(folder)], str(tmp_path / "s"), now, image_folder=str(tmp_path / "i")).first()
        assert (r["images"], r["images_saved"]) == (1, saved)
        assert (r["quality"]["red"], r["quality"]["yellow"], r["quality"]["red_pages"]) == (1, 1, [2]) and r["quality"]["notes"][0].startswith("P2: ")
    assert "红1/黄1/绿0" in ingest.report_line(ingest.ingest(spark, [str(folder)], str(tmp_path / "s"), now)).first()["line"]


def test_red_pages_are_transcribed(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = tmp_path / "in"
    folder.mkdir()
    good = text(50, 700, b"Enough words on this page to be over the least count of characters, so that it is green or so.")
    (folder / "a.pdf").write_bytes(made(good, text(10, 10, b"x"), text(10, 10, b"y")))
    (folder / "n.txt").write_text("plain", encoding="utf-8")
    now = F.lit("2026-01-01").cast("timestamp")

    def read(image, model):
        if image.endswith(b"#3"):
            raise TimeoutError("late")
        return "what page two shows", 10, 5

    render = lambda content, page: content[:4] + b"#%d" % page
    target = str(tmp_path / "s")
    got = {r["doc_id"]: r for r in ingest.ingest(spark, [str(folder)], target, now, transcriber=read, renderer=render, dump_folder=str(tmp_path / "d")).collect()}
    assert got["a"]["transcription"].asDict() == {"pages": 1, "tokens": 15, "note": "1 页转录失败保留原文: P[3]"}
    assert got["n"]["transcription"].asDict() == {"pages": 0, "tokens": 0, "note": None}
    rows = {r["block_id"]: r for r in store.Snapshots(spark, target).read(["a"]).collect()}
    last = rows[f"a:{len(rows) - 1}"]
    assert (last["page"], last["block_type"], last["section"], last["text"]) == (2, "figure_transcript", "第 2 页", "what page two shows")
    assert {r["page"] for r in rows.values()} == {1, 2, 3} and sum(r["page"] == 2 for r in rows.values()) == 1
    dumped = {r["doc_id"]: r["value"] for r in spark.read.option("wholetext", "true").text(str(tmp_path / "d")).collect()}
    assert "what page two shows" in dumped["a"] and dumped["n"].strip().endswith("plain")
    without = {r["doc_id"]: r for r in ingest.ingest(spark, [str(folder)], str(tmp_path / "t"), now).collect()}
    assert without["a"]["transcription"]["note"] == "未配转录模型：2 个红页未转录（保持原文入库）" and without["a"]["status"] == "ok"
