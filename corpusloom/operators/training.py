"""Training examples: token ids of prompt and answer, and labels that mask all but the answer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASKED = -100


def byte_tokens(text: str) -> list[int]:
    """A tokenizer without a vocabulary: UTF-8 bytes, from 1."""
    return [b + 1 for b in text.encode("utf-8", "replace")]


def labelled(df: DataFrame, prompt: str, answer: str, length: int, tokenize: Callable[[str], list[int]] = byte_tokens, pad: int = 0) -> DataFrame:
    """df with input_ids, attention_mask and labels of the given length: cut at its end, padded there; prompt and padding are masked in the labels."""

    @F.pandas_udf("struct<p: array<int>, a: array<int>>")
    def run(prompts: pd.Series, answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"p": [tokenize(t or "") for t in prompts], "a": [tokenize(t or "") for t in answers]})

    held = df.withColumn("__t", run(F.col(prompt), F.col(answer)))
    ids = F.slice(F.concat("__t.p", "__t.a"), 1, length)
    held = held.withColumns({"__ids": ids, "__n": F.least(F.size("__t.p"), F.lit(length))})
    more = F.lit(length) - F.size("__ids")
    fill = lambda v: F.array_repeat(F.lit(v), more)
    return held.select(
        *df.columns,
        F.concat("__ids", fill(pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("__ids")), fill(0)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(MASKED), F.col("__n")), F.slice("__ids", F.col("__n") + 1, F.lit(length)), fill(MASKED)).alias("labels"),
    )
