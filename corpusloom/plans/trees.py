"""Queries over source trees, which are written from the documents first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..session import scratch, table
from ..sources import trees
from .registry import query

#: By doc_id % 12: (path before the id, after it).
PLACES = [
    ("src/", "/__init__.py"), ("src/", "/_util.rs"), (".github/", "/ci.yml"), ("_priv/", ".md"), ("conf/", "/.env"), ("node_modules/", ".js"),
    ("lib/", ".PNG"), ("lib/", ".py"), ("big/", ".json"), ("keys/", ".pem"), ("docs/", "/README"), ("a/.hidden/", ".Java"),
]
_CASES = " ".join(f"WHEN {i} THEN '{a}' || doc_id || '{b}'" for i, (a, b) in enumerate(PLACES))
_TREE = f"""WITH d AS (SELECT doc_id % 12 AS i, doc_id % 120 = 8 AS large, CASE doc_id % 12 {_CASES} END AS path, text FROM documents),
files AS (SELECT path, 'file' AS kind, (octet_length(encode(text)) + CASE WHEN i = 7 THEN 1 WHEN large THEN 1000000 ELSE 0 END)::BIGINT AS length,
  CASE WHEN i IN (4, 9) THEN 'secret' WHEN i = 6 THEN 'unsupported_type' WHEN octet_length(encode(text)) + if(i = 7, 1, if(large, 1000000, 0)) > 1000000 THEN 'too_large' WHEN i = 7 THEN 'binary' END AS skip,
  replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t, text, ['python', 'rust', 'yaml', 'markdown', '', '', '', 'python', 'json', '', 'markdown', 'java'][1 + i] AS language FROM d WHERE i <> 5),
tree AS (SELECT path, kind, length, skip, if(skip IS NULL, sha256(text), NULL) AS sha256, if(skip IS NULL, md5(t), NULL) AS content_md5, language FROM files
  UNION ALL SELECT DISTINCT 'node_modules', 'folder', NULL::BIGINT, 'excluded', NULL, NULL, '' FROM d WHERE i = 5)"""


def _written(spark, sf):
    """The documents as files of a tree: plain, hidden, secret, binary, too large ones, and some in a folder that is excluded."""
    i, number = F.pmod("doc_id", F.lit(12)).cast("int"), F.col("doc_id").cast("string")
    at = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PLACES]), i + 1)
    text = F.when(i == 7, F.concat(F.lit("\0"), "text")).when(F.col("doc_id") % 120 == 8, F.concat("text", F.lit(" " * 1_000_000))).otherwise(F.col("text"))
    root = scratch(spark, "tree")
    trees.write(table(spark, sf, "documents").select(F.concat(at(0), number, at(1)).alias("path"), text.alias("content")), root)
    return root


@query("source_tree", f"{_TREE} SELECT path, kind, length, skip, sha256, content_md5, if(skip IS NULL, language, NULL) AS language FROM tree")
def source_tree(spark, sf):
    language = F.when((F.col("kind") == "file") & F.col("skip").isNull(), C.language("path", "content"))
    return trees.scan(spark, _written(spark, sf)).select("path", "kind", "length", "skip", "sha256", F.md5("content").alias("content_md5"), language.alias("language"))


@query("tree_statistics", f"{_TREE} SELECT CASE WHEN kind = 'folder' THEN 'folder' WHEN skip IS NOT NULL THEN 'skipped' ELSE 'language' END AS what, CASE WHEN kind = 'folder' THEN path ELSE coalesce(skip, language) END AS name, count(*) AS n FROM tree GROUP BY 1, 2")
def tree_statistics(spark, sf):
    return trees.statistics(trees.scan(spark, _written(spark, sf), contents=False))
