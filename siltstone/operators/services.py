"""Stand-ins for the outer services (embedder, language model, OCR, captions): plain functions that a caller may replace."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


def hashing_embedder(dim: int = DIM) -> Callable[[list[str]], list[list[float]]]:
    """Signed counts of hashed words; equal texts give equal vectors anywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(word.encode())
                row[h % dim] += 1 if h >> 16 & 1 else -1
        return out.tolist()

    return embed


def echo_model(prompt: str, model: str | None = None) -> str:
    """Says the last line of its prompt."""
    return prompt.strip().rsplit("\n", 1)[-1]


def fixed_ocr(image: bytes) -> str:
    return f"{len(image or b'')} bytes"


def embed_column(text: Column, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Column:
    own = embed or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(own([t or "" for t in texts])))

    return run(text)


def models(default: str, listed: str | None) -> list[str]:
    """The default first, then the listed ones, each once."""
    return list(dict.fromkeys([default, *(m.strip() for m in (listed or "").split(",") if m.strip())]))


def checked_model(asked: str | None, default: str, listed: str | None) -> str:
    """Blank: the default. One that isn't listed is an error."""
    name = (asked or "").strip() or default
    if name not in models(default, listed):
        raise ValueError(f"model {name!r} is not allowed")
    return name


def answers(prompts: DataFrame, generate: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``answer`` and ``status`` (ok or the error); one call for each row."""

    @F.pandas_udf("struct<answer:string,status:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                try:
                    rows.append((generate(t), "ok"))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["answer", "status"])

    return prompts.withColumn("__a", run(F.col(prompt))).select(*prompts.columns, "__a.answer", "__a.status")
