"""Short texts about files and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import col


def file_summary(files: DataFrame, most: int = 10) -> DataFrame:
    """(path, summary): labelled lines of a file's language, symbols, imports and importance; empty facts have no line."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))
    joined = lambda c: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, most), ", ")
    parts = [line("File", F.col("path")), line("Language", F.col("language")), line("Symbols", joined(F.col("symbols"))), line("Imports", joined(F.col("imports"))), line("Importance", F.col("importance_score").cast("string"))]
    return files.select("path", F.concat_ws("\n", *parts).alias("summary"))


def readme_summary(content: Column | str, most: int = 8, plain: int = 6, chars: int = 1200) -> Column:
    """Headings and the first plain lines of a text, in order, joined: at most most lines, plain ones while under plain lines are held."""
    kept = F.filter(F.transform(X.lines(F.coalesce(col(content), F.lit(""))), lambda x: F.trim(x)), lambda x: x != "")

    def step(acc, x):
        heading = x.startswith("#")
        take = (F.size(acc) < most) & (heading | (F.size(acc) < plain))
        return F.when(take, F.concat(acc, F.array(F.when(heading, F.trim(F.regexp_replace(x, "^#+", ""))).otherwise(x)))).otherwise(acc)

    return F.substring(F.array_join(F.aggregate(kept, F.array().cast("array<string>"), step), " "), 1, chars)


def executive_summary(body: Column | str, chars: int = 500) -> Column:
    """The section of that name without bullets, or the whole body, on one line of at most chars characters."""
    found = F.regexp_extract(col(body), r"(?si)##\s*1\.?\s*Executive Summary\s*(.+?)(?:\n##\s|\z)", 1)
    rows = F.transform(X.lines(F.when(found != "", found).otherwise(col(body))), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*#>]+", "")))
    return X.let(F.array_join(F.filter(rows, lambda x: x != ""), " "), lambda t: F.when(F.length(t) > chars, F.concat(F.rtrim(F.substring(t, 1, chars)), F.lit("…"))).otherwise(t))


def fact_block(label: str, values: Column | str, most: int = 40) -> Column:
    """A labelled bullet list, or a note that nothing was found."""
    held = F.slice(F.coalesce(col(values), F.array().cast("array<string>")), 1, most)
    return X.let(held, lambda v: F.concat(F.lit(f"{label}:\n"), F.when(F.size(v) == 0, "(none detected)").otherwise(F.concat(F.lit("- "), F.array_join(v, "\n- ")))))
