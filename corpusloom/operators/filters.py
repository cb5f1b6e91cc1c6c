"""Record filters: one reason column, whose first rule that fails names the drop."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexing
from ..functions import text as X

# Fixed values
STRICTNESS = {"auto_complete": "strict", "code_gen": "strict", "refactoring": "strict", "test_gen": "strict", "perf_opt": "strict", "bug_detection": "lenient", "bug_fix": "lenient"}
REQUIRED = ["id", "objective", "language", "input", "output", "context", "metadata"]
NON_ASCII = 0.20


def reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds, or null; a null condition doesn't hold."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in rules])


def corpus_reasons(df: DataFrame, languages: list[str], max_chars: int | None = None, threshold: float = NON_ASCII) -> DataFrame:
    """df with a column reason: language_filtered, encoding_filtered, too_long or null."""
    rules = [
        ("language_filtered", ~F.coalesce(F.col("language").isin(languages), F.lit(False))),
        ("encoding_filtered", X.non_ascii_ratio(X.encoding_blob("input", "output", "context")) > threshold),
    ]
    if max_chars is not None:
        rules.append(("too_long", F.length("input") > max_chars))
    return df.withColumn("reason", reason(rules))


def validity(df: DataFrame) -> DataFrame:
    """df with a column reason: the first required key that is missing, or blank input or output, or null."""
    rules = [(f"missing_{k}", F.col(k).isNull() if k in df.columns else F.lit(True)) for k in REQUIRED]
    rules += [("empty_metadata", F.size("metadata") == 0)] if "metadata" in df.columns else []
    rules += [(f"blank_{k}", F.trim(F.col(k)) == "") for k in ("input", "output") if k in df.columns]
    return df.withColumn("reason", reason(rules))


def encodable(c: Column | str) -> Column:
    """Whether a text, or bytes taken as one, is valid UTF-8: a lone surrogate and a cut-off character are not. A null isn't."""
    return F.coalesce(F.is_valid_utf8(X.col(c).cast("string")), F.lit(False))


def stream_gates(df: DataFrame, languages: list[str], include: list[str] = (), must_match: bool = True, max_chars: int = 0, snippet: bool = False, language: str = "language", text: str = "code") -> DataFrame:
    """df with a column reason, by the rules of a stream: unsupported_language, not_included (both only if languages must match), max_chars_exceeded, not_snippet_like or null."""
    lang = X.alias_language(language)
    rules = []
    if must_match:
        rules.append(("unsupported_language", ~lang.isin(*languages)))
        if include:
            wanted = F.array(*[X.alias_language(F.lit(x)) for x in include])
            rules.append(("not_included", ~F.array_contains(wanted, lang)))
    if max_chars > 0:
        rules.append(("max_chars_exceeded", F.length(text) > max_chars))
    if snippet:
        rules.append(("not_snippet_like", ~X.looks_like_snippet(text)))
    return df.withColumn("reason", reason(rules) if rules else F.lit(None).cast("string"))


def counts_by_reason(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def broken(schema: T.StructType, infinite: bool = False) -> Column:
    """True if any value in the row, however nested, is null, NaN or (if infinite) infinite."""

    def bad(c: Column, kind: T.DataType) -> Column:
        found = c.isNull()
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            found |= F.isnan(c)
            if infinite:
                found |= F.abs(c) == float("inf")
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                found |= bad(c[f.name], f.dataType)
        elif isinstance(kind, T.ArrayType):
            found |= F.exists(c, lambda x: bad(x, kind.elementType))
        elif isinstance(kind, T.MapType):
            found |= F.exists(F.map_values(c), lambda x: bad(x, kind.valueType))
        return F.coalesce(found, F.lit(True))

    out = F.lit(False)
    for f in schema.fields:
        out |= bad(F.col(f"`{f.name}`"), f.dataType)
    return out


def _balanced(code: str) -> float:
    """The share of brackets without a partner: a stand-in for a parser's error ratio."""
    pairs, stack, wrong, n = {")": "(", "]": "[", "}": "{"}, [], 0, 0
    for ch in code:
        if ch in "([{":
            stack.append(ch)
            n += 1
        elif ch in pairs:
            n += 1
            if stack and stack[-1] == pairs[ch]:
                stack.pop()
            else:
                wrong += 1
    return (wrong + len(stack)) / n if n else 1.0


def error_ratio(language: str | None, code: str | None) -> float | None:
    """0 for code that parses, up to 1; null without code. Python is parsed, other languages have their brackets matched, those in comments and literals aside."""
    if not code:
        return None
    if language == "python":
        try:
            ast.parse(code)
            return 0.0
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return max(_balanced(code), 0.01)
    return _balanced(lexing.blanked(code, language) if language in lexing.LITERALS else code)


def syntax_kept(df: DataFrame, languages: list[str] = ("python", "java", "javascript", "cpp", "csharp")) -> DataFrame:
    """df with a boolean kept: a span of input, context or output parses, or comes near enough for a lenient objective."""

    @F.pandas_udf("double")
    def ratio(language: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([error_ratio(a, b) for a, b in zip(language, code)], dtype="float64")

    best = []
    for c in ("input", "context", "output"):
        span = F.lit("")
        for language in languages:
            span = F.when(F.col("language") == language, X.code_span(c, language)).otherwise(span)
        best.append(ratio(F.col("language"), span))
    lenient = F.col("objective").isin([o for o, m in STRICTNESS.items() if m == "lenient"])
    least = F.least(*best)
    kept = (F.col("objective") == "bug_fix") | (F.col("language").isin(list(languages)) & ((least == 0) | (lenient & (least <= 0.5))))
    return df.withColumn("kept", F.coalesce(kept, F.lit(False)))


def any_parses(df: DataFrame, columns: list[str] = ("input", "context", "output"), language: str = "language") -> DataFrame:
    """df with a boolean kept: one of the columns parses as it stands, in full; no objective is excused."""

    @F.pandas_udf("boolean")
    def clean(languages: pd.Series, *texts: pd.Series) -> pd.Series:
        return pd.Series([any(error_ratio(a, t) == 0 for t in row if t) for a, *row in zip(languages, *texts)], dtype="bool")

    return df.withColumn("kept", clean(F.col(language), *[F.col(c) for c in columns]))
