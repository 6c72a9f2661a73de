"""The slow path of red pages: a transcriber, behind an interface, reads them again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docloom.session import ship

MOST, TRIES = 20, 2


class Transcriber(Protocol):
    """(page image, model) to (text, prompt tokens, completion tokens); raises where it can't."""

    def __call__(self, image: bytes, model: str) -> tuple[str, int, int]: ...


def transcribed(pages: DataFrame, transcriber: Transcriber, models: tuple[str, ...] = ("primary", "fallback"), most: int = MOST) -> DataFrame:
    """Red pages (doc_id, page, image) with text, prompt_tokens, completion_tokens and error.

    The first ``most`` pages of a document are read; each model gets TRIES tries; a
    page that fails keeps a null text and does not stop the others.
    """
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)
    first = pages.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("page")), 1, most).alias("_pages"))
    chosen = pages.join(first, "doc_id").where(F.array_contains("_pages", F.col("page"))).select("doc_id", "page", "image")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image in batch["image"]:
                error = None
                for model in [m for m in models for _ in range(TRIES)]:
                    try:
                        rows.append((*transcriber(image, model), None))
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                else:
                    rows.append((None, 0, 0, error))
            yield pd.concat([batch[["doc_id", "page"]].reset_index(drop=True), pd.DataFrame(rows, columns=["text", "prompt_tokens", "completion_tokens", "error"])], axis=1)

    return chosen.mapInPandas(run, f"doc_id {kind['doc_id']}, page {kind['page']}, text string, prompt_tokens long, completion_tokens long, error string")
