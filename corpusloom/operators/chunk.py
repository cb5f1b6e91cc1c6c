"""Chunkers: line windows, headed sections, Python definitions, brace blocks."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions import text as X

WINDOW, OVERLAP = 120, 12
CHUNK = "array<struct<chunk_type: string, symbol: string, scope: string, start_line: int, end_line: int, content: string>>"


def window_starts(n, size: int = WINDOW, overlap: int = OVERLAP):
    """Starts from 0 of the windows over n lines: each step until one reaches the end."""
    step = max(1, size - overlap)
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.filter(every, lambda s: (s == 0) | (s - step + size < n))).otherwise(F.array().cast("array<int>"))


def line_windows(df: DataFrame, content: str = "content", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """A row per window: the columns of df but content, and start_line, end_line (from 1), chunk. Texts without lines give none."""
    held = df.select(*[c for c in df.columns if c != content], X.lines(F.coalesce(content, F.lit(""))).alias("__l"))
    starts = held.withColumn("__s", F.explode(window_starts(F.size("__l"), size, overlap)))
    end = F.least(F.col("__s") + size, F.size("__l"))
    body = F.array_join(F.slice("__l", F.col("__s") + 1, F.lit(size)), "\n")
    rest = [c for c in df.columns if c != content]
    return starts.select(*rest, (F.col("__s") + 1).cast("long").alias("start_line"), end.cast("long").alias("end_line"), body.alias("chunk"))


def sections(df: DataFrame, content: str = "content", title: int = 80) -> DataFrame:
    """A row per headed section of a Markdown text; what stands before the first heading has none. A heading without a name is "documentation"."""
    rest = [c for c in df.columns if c != content]
    held = df.select(*rest, X.lines(F.coalesce(content, F.lit(""))).alias("__l"))
    at = F.filter(F.transform("__l", lambda x, i: F.when(x.startswith("#"), i)), lambda i: i.isNotNull())
    held = held.withColumn("__h", at).select(*rest, "__l", "__h", F.posexplode("__h").alias("__k", "__a"))
    end = F.coalesce(F.get("__h", F.col("__k") + 1), F.size("__l"))
    name = F.trim(F.regexp_replace(F.get("__l", F.col("__a")), "^#+", ""))
    name = F.substring(F.when(name == "", "documentation").otherwise(name), 1, title)
    body = F.array_join(F.slice("__l", F.col("__a") + 1, end - F.col("__a")), "\n")
    return held.select(*rest, (F.col("__a") + 1).cast("long").alias("start_line"), end.cast("long").alias("end_line"), name.alias("title"), body.alias("chunk"))


def document_chunks(df: DataFrame, content: str = "content", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of Markdown texts: a doc_section for each section, doc_windows of a longer one, doc windows of a text without headings."""
    rest = [c for c in df.columns if c != content]
    span = lambda kind, symbol: (F.lit(kind).alias("chunk_type"), symbol.cast("string").alias("symbol"), F.lit(None).cast("string").alias("scope"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "chunk")
    found = sections(df, content).withColumn("__n", F.col("end_line") - F.col("start_line") + 1)
    short = found.where(F.col("__n") <= size).select(*rest, *span("doc_section", F.col("title")))
    moved = found.where(F.col("__n") > size).select(*rest, F.col("start_line").alias("__from"), F.col("chunk").alias("__body"))
    moved = line_windows(moved, "__body", size, overlap)
    moved = moved.withColumns({"start_line": F.col("start_line") + F.col("__from") - 1, "end_line": F.col("end_line") + F.col("__from") - 1})
    headed = F.exists(X.lines(F.coalesce(content, F.lit(""))), lambda x: x.startswith("#"))
    plain = line_windows(df.where(~headed), content, size, overlap)
    return short.unionByName(moved.select(*rest, *span("doc_window", F.lit(None)))).unionByName(plain.select(*rest, *span("doc", F.lit(None))))


def _windows(kind: str, symbol: str | None, scope: str | None, first: int, rows: list[str], size: int, overlap: int) -> list[dict]:
    """A span as one chunk, or as windows where it is longer than size."""
    make = lambda k, a, b: {"chunk_type": k, "symbol": symbol, "scope": scope, "start_line": first + a + 1, "end_line": first + b, "content": "\n".join(rows[a:b])}
    if len(rows) <= size:
        return [make(kind, 0, len(rows))]
    out, step = [], max(1, size - overlap)
    for a in range(0, len(rows), step):
        out.append(make(f"{kind}_window", a, min(a + size, len(rows))))
        if a + size >= len(rows):
            break
    return out


def python_chunks(code: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[dict]:
    """Top-level functions and classes; a class longer than size gives its members instead, a longer function windows. Without a parse, none."""
    try:
        todo = [(node, None) for node in ast.parse(code).body]
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows, out = code.splitlines(), []
    while todo:
        node, scope = todo.pop()
        if isinstance(node, ast.ClassDef) and node.end_lineno - node.lineno >= size:
            todo += [(member, node.name) for member in node.body]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out += _windows(kind, node.name, scope, node.lineno - 1, rows[node.lineno - 1 : node.end_lineno], size, overlap)
    return sorted(out, key=lambda c: (c["start_line"], c["end_line"]))


# Fixed values
BLOCK_STARTS = {
    "rust": [("function", r"\bfn\s+([A-Za-z_]\w*)\s*\("), ("class", r"\b(?:struct|enum|trait|impl)\s+([A-Za-z_]\w*)")],
    "typed": [("class", r"\b(?:class|interface|struct|enum)\s+([A-Za-z_]\w*)"), ("function", r"[\w:<>,~*&\[\]]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?\{")],
    "script": [("class", r"\bclass\s+([A-Za-z_]\w*)"), ("function", r"\bfunction\s+([A-Za-z_]\w*)\s*\("), ("function", r"\b(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\(")],
}
BRACED = ("javascript", "typescript", "java", "cpp", "csharp", "rust")
WINDOW_KIND = {"markdown": "doc", "yaml": "config", "json": "config", "config": "config", "dockerfile": "config"}


def brace_chunks(code: str, language: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[dict]:
    """Blocks that begin with a symbol and end where their braces close; the scan goes on behind a block. Comments and literals have neither symbols nor braces."""
    kind = "rust" if language == "rust" else "typed" if language in ("java", "cpp", "csharp") else "script"
    starts = [(k, re.compile(p)) for k, p in BLOCK_STARTS[kind]]
    rows, bare, out, i = code.splitlines(), lexing.blanked(code, language).splitlines(), [], 0
    while i < len(rows):
        found = next(((k, m[1]) for k, p in starts if (m := p.search(bare[i]))), None)
        end = None
        if found:
            depth, opened = 0, False
            for j in range(i, len(rows)):
                depth += bare[j].count("{") - bare[j].count("}")
                opened |= "{" in bare[j]
                if opened and depth <= 0:
                    end = j
                    break
        if end is None:
            i += 1
            continue
        out += _windows(found[0], found[1], None, i, rows[i : end + 1], size, overlap)
        i = end + 1
    return out


def symbol_chunks(df: DataFrame, content: str = "content", language: str = "language", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of source files: symbols or sections where there are any, else windows, whose type is that of the language.

    Adds chunk_type, symbol, scope, start_line, end_line, chunk to the columns of df but content. Only code goes to Python.
    """

    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        out = []
        for code, kind in zip(texts, languages):
            code = code or ""
            made = python_chunks(code, size, overlap) if kind == "python" else brace_chunks(code, kind, size, overlap)
            if not made and (rows := code.splitlines()):
                made = [c | {"chunk_type": "window"} for c in _windows("window", None, None, 0, rows, size, overlap)]
            out.append(made)
        return pd.Series(out)

    rest = [c for c in df.columns if c != content]
    lang = F.coalesce(F.col(language), F.lit(""))
    code = lang.isin("python", *BRACED)
    held = df.where(code).select(*rest, F.explode(run(F.col(content), F.col(language))).alias("__c"))
    held = held.select(*rest, "__c.chunk_type", "__c.symbol", "__c.scope", "__c.start_line", "__c.end_line", F.col("__c.content").alias("chunk"))
    kinds = F.create_map(*[F.lit(x) for kv in WINDOW_KIND.items() for x in kv])
    other = line_windows(df.where(~code & (lang != "markdown")), content, size, overlap)
    other = other.select(*rest, F.coalesce(F.try_element_at(kinds, F.col(language)), F.lit("window")).alias("chunk_type"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("scope"), F.col("start_line").cast("int"), F.col("end_line").cast("int"), "chunk")
    return held.unionByName(document_chunks(df.where(lang == "markdown"), content, size, overlap)).unionByName(other)
