"""Blocks of JSON texts: one for each element, with its path.

Spark's own JSON types sort or fix the keys of objects; the order of keys is kept
here, so this runs in Python, in Arrow batches.  A text that is not JSON gives a
row with an error and no blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.operators.chunking import BLOCK, fit
from docloom.session import ship

FOUND = "struct<error:string,items:array<struct<section:string,text:string>>>"


def flattened(value, path: str) -> str:
    """``path：value`` of every scalar below, depth first, in the order of the keys."""
    out, todo = [], [(path, value)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}.{k}" if at else str(k), v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
        else:
            out.append(f"{at}：{x}")
    return "\n".join(out)


def elements(value) -> Iterator[tuple[str, str]]:
    """(path, text) of the elements of a JSON value; lists of objects are opened, other lists stay whole."""
    if isinstance(value, list):
        todo = [(f"$[{i}]", x) for i, x in enumerate(value)]
    elif isinstance(value, dict):
        todo = [(f"$.{k}", x) for k, x in value.items()]
    else:
        todo = [("$", value)]
    todo.reverse()
    while todo:
        path, x = todo.pop()
        if isinstance(x, list) and x and all(isinstance(i, dict) for i in x):
            todo += [(f"{path}[{n}]", i) for n, i in reversed(list(enumerate(x)))]
        elif text := flattened(x, path) if isinstance(x, dict) else str(x):
            yield path, text


def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        try:
            rows.append((None, [{"section": p, "text": x} for p, x in elements(json.loads((t or "").removeprefix("\ufeff")))]))
        except (json.JSONDecodeError, RecursionError) as e:
            rows.append((f"JSON 解析失败（第 {getattr(e, 'lineno', 0)} 行）：{getattr(e, 'msg', e)}", []))
    return pd.DataFrame(rows, columns=["error", "items"])


def parsed(text: Column) -> Column:
    return F.pandas_udf(_parse, FOUND)(text)


def json_blocks(items: Column) -> Column:
    """Blocks of the parsed elements; long ones are cut like any text."""
    typed = lambda x: F.transform(fit(x["text"]), lambda t: F.struct(x["section"].alias("section"), F.lit("json_item").alias("block_type"), t.alias("text")))
    return F.flatten(F.transform(items, typed)).cast(BLOCK)


def with_json(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with error and blocks."""
    ship(docs.sparkSession)
    return docs.withColumn("_json", parsed(F.col(text))).withColumns({"error": F.col("_json.error"), "blocks": json_blocks(F.col("_json.items"))}).drop("_json")
