"""Column functions over texts, titles, questions and answers; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docloom.functions.arrays import bound

# Sizes of blocks, in code points.
TARGET, MAX, OVERLAP = 900, 1200, 80
TOP_K, SNIPPET, CONTEXT = 5, 160, 1500
# Patterns.  White space is that of Unicode plus the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SENTENCE_END = "(?<=[。！？!?；;])"
IMAGE = r"\[IMAGE:([A-Za-z0-9_.-]+)\]"
CITATION = r"\[(\d+)\]"
YEAR = r"(?<!\d)(20[0-2]\d)(?!\d)"
FULL_DATE = r"(?<!\d)(20[0-2]\d)(?U)\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})(?:\s*日)?(?!\d)"
CJK = r"[\u4e00-\u9fff\u3400-\u4dbf]"
BROKEN = r"[\ufffd\x00-\x08\x0b\x0c\x0e-\x1f]"
# Words and sentences of the answers.
GREETINGS = ("你好", "您好", "hi", "hello", "嗨", "谢谢", "感谢", "再见", "你是谁", "在吗", "在么")
NO_SOURCE_HINT = "（注：以上为综合回答，知识库中未检索到可直接引用的文档出处。）"
UNKNOWN_DOCUMENT = "未知文档"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_long(text: Column) -> Column:
    """strip(text) that reads only the ends of a text that has no white space there."""

    def cut(t: Column) -> Column:
        ends = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
        return F.when(ends.rlike(SPACE), strip(t)).otherwise(t)

    return bound(text, cut)


def lines(text: Column) -> Column:
    """Lines as Python's splitlines cuts them, but for an empty last one, which no operator counts."""
    return F.split(text, LINE_END, -1)


def normalise(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, rf"{SPACE}+", ""))


def doc_date(title: Column) -> Column:
    """YYYY-MM-DD of the first full date if its month and day can be, else the first year, else null."""
    year, month, day = (F.regexp_extract(title, FULL_DATE, i) for i in (1, 2, 3))
    good = (year != "") & month.try_cast("int").between(1, 12) & day.try_cast("int").between(1, 31)
    only = F.regexp_extract(title, YEAR, 1)
    return F.when(good, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))).when(only != "", only)


def doc_year(date: Column) -> Column:
    return F.substring(date, 1, 4).cast("int")


def question_years(question: Column) -> Column:
    """Sorted distinct years 2000 to 2029 that stand alone; null if there are none."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))))
    return F.when(F.size(found) > 0, found)


def is_greeting(question: Column, whole_words: bool = False) -> Column:
    """A short question with a greeting in it; ``whole_words``: Latin greetings count only as words."""
    asked = strip(question)
    if whole_words:
        marked = [F.lower(asked).rlike(rf"\b{g}\b") if g.isascii() else asked.contains(g) for g in GREETINGS]
    else:
        marked = [F.lower(asked).contains(g) for g in GREETINGS]
    found = marked[0]
    for m in marked[1:]:
        found = found | m
    return F.coalesce((F.length(asked) <= 40) & found, F.lit(False))


def image_id(stem: Column, data: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.substring(F.md5(data), 1, 10))


def image_ids(text: Column) -> Column:
    """Ids of the placeholders in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)))


def images_shown(text: Column) -> Column:
    return F.regexp_replace(text, IMAGE, "(图)")


def is_page_number(text: Column) -> Column:
    return text.rlike(r"\A(?U:[\s\x1c-\x1f]*)[0-9]{1,4}(?U:[\s\x1c-\x1f]*)\z")


def fingerprint(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def cited(answer: Column, valid: Column) -> Column:
    """Numbers of the citations from 1 to ``valid``, each once, in order."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda n: n.isNotNull() & n.between(F.lit(1), valid)))


def without_ghosts(answer: Column, valid: Column) -> Column:
    """The answer without citations out of 1 .. ``valid``."""
    parts = F.split(answer, r"(?=\[\d+\])", -1)

    def kept(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^\[(\d+)\]", 1)
        ghost = (digits != "") & ~F.coalesce(digits.try_cast("int").between(F.lit(1), valid), F.lit(False))
        return F.when(ghost, F.regexp_replace(part, r"^\[\d+\]", "")).otherwise(part)

    return strip(F.array_join(F.transform(parts, kept), ""))


def with_hint(answer: Column, refs: Column, hits: Column) -> Column:
    """The hint that nothing is cited, where there were hits and the answer doesn't say that nothing was found."""
    bare = (F.size(refs) == 0) & (hits > 0) & (answer != "") & ~F.substring(answer, 1, 20).contains("未找到")
    return F.when(bare, F.concat(answer, F.lit("\n\n" + NO_SOURCE_HINT))).otherwise(answer)


def document_name(title: Column, source_file: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(source_file, F.lit("")), F.lit(UNKNOWN_DOCUMENT))


def snippet(text: Column) -> Column:
    return F.substring(strip(images_shown(F.coalesce(text, F.lit("")))), 1, SNIPPET)


def prompt_block(number: Column, title: Column, source_file: Column, page: Column, date: Column, text: Column) -> Column:
    """A numbered block of the context: its source, then its text."""
    where = F.when(page.isNotNull() & (page != 0), F.concat(F.lit("，第 "), page.cast("string"), F.lit(" 页"))).otherwise("")
    when = F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit("，文档日期 "), date)).otherwise("")
    head = F.concat(F.lit("["), number.cast("string"), F.lit("]（来源："), document_name(title, source_file), where, when, F.lit("）\n"))
    return F.concat(head, F.substring(images_shown(F.coalesce(text, F.lit(""))), 1, CONTEXT))


def eta_seconds(pages: Column, size: Column) -> Column:
    """Expected seconds to ingest: 2 a page where the pages are known, else 20 a MB, 20 at least; never under 15."""
    by_size = F.greatest(F.lit(20.0), size / F.lit(1024.0 * 1024.0) * 20.0)
    return F.greatest(F.lit(15.0), F.when(pages > 0, pages * 2.0).otherwise(by_size)).cast("int")


def eta_words(seconds: Column) -> Column:
    minutes = F.bround(seconds / F.lit(60.0)).cast("int").cast("string")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" 秒"))).otherwise(F.concat(minutes, F.lit(" 分钟")))


def page_signals(text: Column) -> dict[str, Column]:
    """Counts of a page's text that its quality is judged by."""
    count = lambda c: F.regexp_count(text, F.lit(c))
    latin, cjk, lower = count("[A-Za-z]"), count(CJK), count("[a-z]")
    return {
        "chars": F.length(F.regexp_replace(text, rf"{SPACE}+", "")),
        "cjk": cjk,
        "latin": latin,
        "fffd": count(BROKEN),
        "lower_ratio": F.when((latin >= 150) & (latin > cjk), lower / latin),
    }
