"""Queries from files to found rows: an index that is renewed, embedded and searched; searches by stored structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..operators import cells, graph, index, inverted, retrieve, store
from ..session import checkpointed, scratch, table
from .code import _LINES
from .registry import query
from .retrieval import _ANY, _CHUNKS, _COS, _POINT, FRAGMENTS, SYMBOLS, TERMS, _docs_as_chunks, _points

PROJECT, ASKED = "/work/app", "What does this project explain"
_WORDS = ("what", "does", "project", "explain")


def _files(spark, sf):
    """Documents as files, a hundred a folder."""
    folder = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"))
    return table(spark, sf, "documents").select(F.concat_ws("/", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.lit("text").alias("language"), F.col("text").alias("content"), F.sha2("text", 256).alias("sha256"))


_COUNTED = " + ".join("len(regexp_extract_all(t, '{}'))".format(p.replace("'", "''")) for p in C.SYMBOL_COUNT)
_BOOST = "least(0.60, " + " + ".join(f"0.24 * (contains(path, '{w}') OR contains(folder, '{w}'))::INT + 0.14 * contains(low, '{w}')::INT + 0.18 * contains(path, '{w}')::INT" for w in _WORDS) + " + 0.20 * contains(low, 'what')::INT)"


_OWNER = f"substr(sha256('{PROJECT}'), 1, 24)"


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"list_transform([{h}], lambda h: substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INT & 3), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))[1]"


_IDS = f"CASE c WHEN 2 THEN {_uuid(f"{_OWNER} || ':' || rel || ':file_summary'")} WHEN 3 THEN {_uuid(f"{_OWNER} || '|' || rel || '|' || a || '|' || b || '||' || sha")} ELSE rel END"


@query("index_retrieval", f"""WITH RECURSIVE d AS (SELECT doc_id, source || '/' || doc_id // 100 AS folder, source || '/' || doc_id // 100 || '/' || doc_id || '.txt' AS rel, text AS t FROM documents),
e AS (SELECT *, {_LINES} AS l, round(least(({_COUNTED}) * 0.05, 0.5), 4)::DOUBLE AS imp FROM d),
w AS (SELECT *, unnest(range(0, len(l), 108)) AS s FROM e),
mp AS (SELECT 'unknown/generic project. Frameworks: none detected. Languages: text=' || count(*) || '.' AS content FROM d),
p AS (SELECT 1 AS c, folder AS rel, 'folder_summary' AS kind, NULL::BIGINT AS a, NULL::BIGINT AS b, 'Folder: ' || folder || chr(10) || 'Contains:' || chr(10) || string_agg('- ' || rel, chr(10) ORDER BY rel) AS content, '' AS path, '' AS folder, 1.0 AS s, 0.0 AS imp, '' AS sha FROM d GROUP BY folder
 UNION ALL SELECT 2, rel, 'file_summary', NULL, NULL, 'File: ' || rel || chr(10) || 'Language: text' || chr(10) || 'Lines: ' || len(l) || chr(10) || 'Purpose: Source file.', '{PROJECT}/' || rel, '', CASE WHEN rel IN (SELECT rel FROM (SELECT rel FROM e WHERE imp > 0 ORDER BY imp DESC, rel LIMIT 80)) THEN 0.90 WHEN imp > 0.5 THEN 0.80 ELSE 0.60 END, imp, '' FROM e
 UNION ALL SELECT 3, rel, 'window', s + 1, least(s + 120, len(l)), array_to_string(l[s + 1:s + 120], chr(10)), '{PROJECT}/' || rel, folder, CASE WHEN rel IN (SELECT rel FROM (SELECT rel FROM e WHERE imp > 0 ORDER BY imp DESC, rel LIMIT 80)) THEN 0.65 ELSE 0.50 END, imp, sha256(t) FROM w WHERE s = 0 OR s - 108 + 120 < len(l)),
x AS MATERIALIZED (SELECT *, lower(content) AS low, row_number() OVER (ORDER BY c, -s, {_IDS}) AS i, length(content) AS n FROM p),
small AS MATERIALIZED (SELECT i, n, row_number() OVER (ORDER BY i) AS r FROM x WHERE c > 1),
f AS (SELECT 0::BIGINT AS r, (25000 - (SELECT length(content) FROM mp) - (SELECT sum(n) FROM x WHERE c = 1))::BIGINT AS budget, false AS kept UNION ALL SELECT small.r, CASE WHEN n <= budget THEN budget - n ELSE budget END, n <= budget FROM f JOIN small ON small.r = f.r + 1),
o AS (SELECT x.* FROM x WHERE c = 1 UNION ALL SELECT x.* FROM f JOIN small USING (r) JOIN x USING (i) WHERE kept),
o1 AS (SELECT * FROM o QUALIFY c = 1 OR row_number() OVER (PARTITION BY path ORDER BY i) = 1),
r AS (SELECT rel, kind, a, b, round(least(1.0, s + {_BOOST} + least(imp * 0.08, 0.20)), 9) AS score FROM o1
 UNION ALL SELECT 'project_map', 'project_map', NULL, NULL, round(least(1.0, least(0.82, 0.64 + 0.04 * ({" + ".join(f"contains(lower(content), '{w}')::INT" for w in _WORDS)})) + least(0.60, {" + ".join(f"0.14 * contains(lower(content), '{w}')::INT" for w in _WORDS)}) + 0.10), 9) FROM mp)
SELECT rel AS relative_path, kind AS chunk_type, a::INT AS start_line, b::INT AS end_line, round(score, 6)::DOUBLE AS score FROM r""")
def index_retrieval(spark, sf):
    """An index of older texts is renewed to all documents, embedded, and asked about the project as a whole."""
    files = _files(spark, sf)
    old = files.withColumn("content", F.concat(F.lit("old\n"), "content")).withColumn("sha256", F.when(F.length("content") % 3 == 0, F.col("sha256")).otherwise(F.sha2("content", 256)))
    old = old.withColumn("content", F.when(F.length("content") % 3 == 0, F.substr("content", F.lit(5))).otherwise(F.col("content")))
    nothing, edges = files.limit(0), graph.build(files)
    points, state, _ = index.renewed(old, nothing.select("path", "sha256"), index.payloads(nothing, PROJECT), PROJECT, edges=edges)
    points, _, _ = index.renewed(files, state, checkpointed(points), PROJECT, edges=edges)
    points = checkpointed(index.embedded(points, 16))
    found = retrieve.retrieve(points, retrieve.asked(spark, ASKED, 16), 5, task_name="project_explain", project=PROJECT)
    return found.select("relative_path", "chunk_type", "start_line", "end_line", F.round("score", 6).cast("double").alias("score"))


@query("keyword_index_search", f"SELECT id, 0.55::DOUBLE AS score FROM {_CHUNKS} WHERE {_ANY} ORDER BY id LIMIT 50")
def keyword_index_search(spark, sf):
    """The rows of keyword_search, by posting lists of trigrams that are written first."""
    path = scratch(spark, "inverted")
    inverted.build(_docs_as_chunks(spark, sf), path, parts=16)
    return inverted.search(spark, path, SYMBOLS + TERMS, FRAGMENTS, 50).select("id", F.col("score").cast("double").alias("score"))


@query("trigram_postings", """WITH t AS (SELECT doc_id, lower(text) || '  ' || source || '/' || doc_id || '.py ' || source AS t FROM documents)
SELECT word, doc_id AS id FROM t, (VALUES ('parser'), ('ereaned'), ('tion'), ('and the')) w(word) WHERE contains(t, word)""")
def trigram_postings(spark, sf):
    """Candidates of each word, verified: the index finds all points that have it."""
    path, points = scratch(spark, "inverted"), _docs_as_chunks(spark, sf)
    inverted.build(points, path, parts=16)
    found = inverted.postings(spark, path, ["parser", "ereaned", "tion", "and the"])
    held = spark.read.parquet(f"{path}/points").join(found, F.col("id") == F.col("key"))
    return held.where(F.col("__blob").contains(F.col("word"))).select("word", "id")


@query("vector_cells_topk", f"WITH p AS ({_POINT}), r AS (SELECT q.id AS query, p.id, {_COS} AS s, row_number() OVER (PARTITION BY q.id ORDER BY {_COS} DESC, p.id) AS rank FROM p, p q WHERE q.id % 50 = 0) SELECT query, id, round(s, 6) AS score, rank FROM r WHERE rank <= 5")
def vector_cells_topk(spark, sf):
    """The rows of vector_batch_topk, by cells that are written first; cells and points that can't be among the nearest aren't scored."""
    path, points = scratch(spark, "cells"), _points(spark, sf)
    cells.build(points, path, 32)
    asked = points.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    return cells.search(spark, path, asked, 5).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("bucketed_upsert", "SELECT vec_id AS id, if(vec_id % 9 = 0, -1, label) AS label FROM embeddings WHERE vec_id % 9 = 0 OR label IS DISTINCT FROM 2 UNION ALL SELECT vec_id + 10000000, -2 FROM embeddings WHERE vec_id % 11 = 0")
def bucketed_upsert(spark, sf):
    """A table of points in buckets: points of a label go, some change, some come; and it's read again."""
    path, points = scratch(spark, "store"), _points(spark, sf).select("id", "label")
    store.create(points, path, "id", 16)
    store.delete_where(spark, path, {"label": "2"})
    changed = points.where("id % 9 = 0").withColumn("label", F.lit(-1))
    store.upsert(changed.unionByName(points.where("id % 11 = 0").select(F.col("id") + 10000000, F.lit(-2)).toDF("id", "label")), path)
    return store.read(spark, path)
