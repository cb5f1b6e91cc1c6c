"""Queries of indexes and of verification: points of a project, identities, neighbours, ingestion, checks of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk, filters, graph, index, rules, shape, verify
from ..session import OBJECTIVES, RECORDS_SQL, checkpointed, records, table
from ..sources import readers
from .code import _EDGES, _LINES, _edges
from .registry import query

_R = RECORDS_SQL
_HEADED = "regexp_replace(text, '(^|\\n)(T[a-z]*)', '\\1## \\2', 'g')"
_WIN = "CASE WHEN len(l) > 0 THEN list_filter(range(0, len(l), 15), lambda s: s = 0 OR s - 15 + 20 < len(l)) ELSE [] END"


@query("document_chunks", f"""WITH d AS (SELECT doc_id, {_LINES} AS l FROM (SELECT doc_id, {_HEADED} AS t FROM documents)),
h AS (SELECT doc_id, l, unnest(list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '#'))) AS a FROM d),
e AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1, len(l)) AS b FROM h),
s AS (SELECT doc_id, 'doc_section' AS chunk_type, a, b, substr(coalesce(nullif(trim(ltrim(l[a], '#')), ''), 'documentation'), 1, 80) AS symbol FROM e WHERE b - a + 1 <= 20),
w AS (SELECT doc_id, 'doc_window' AS chunk_type, a + s AS a, least(a + s + 19, b) AS b, NULL AS symbol FROM (SELECT doc_id, a, b, unnest(range(0, b - a + 1, 15)) AS s FROM e WHERE b - a + 1 > 20) WHERE s = 0 OR s - 15 + 20 < b - a + 1),
p AS (SELECT doc_id, 'doc' AS chunk_type, s + 1 AS a, least(s + 20, len(l)) AS b, NULL AS symbol FROM (SELECT doc_id, l, unnest({_WIN}) AS s FROM d WHERE NOT list_bool_or(list_transform(l, lambda x: starts_with(x, '#')))))
SELECT doc_id, chunk_type, a::INT AS start_line, b::INT AS end_line, symbol FROM (SELECT * FROM s UNION ALL SELECT * FROM w UNION ALL SELECT * FROM p)""")
def document_chunks(spark, sf):
    held = table(spark, sf, "documents").select("doc_id", F.lit("markdown").alias("language"), F.regexp_replace("text", "(^|\\n)(T[a-z]*)", "$1## $2").alias("content"))
    return chunk.symbol_chunks(held, size=20, overlap=5).select("doc_id", "chunk_type", "start_line", "end_line", "symbol")


def _files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("text").alias("language"), F.col("text").alias("content"), F.sha2("text", 256).alias("sha256"), "doc_id")


def _no_edges(files):
    """The graph of texts that import nothing."""
    return files.select(F.col("path").alias("src"), F.col("path").alias("dst"), F.lit("FILE_IMPORTS_FILE").alias("relation")).limit(0)


_SCAN = "SELECT doc_id, source || '/' || doc_id || '.txt' AS path, source AS folder, sha256(text) AS sha, text AS t FROM documents"


@query("index_points", f"""WITH f AS ({_SCAN}), l AS (SELECT path, sha, {_LINES} AS l FROM f),
w AS (SELECT path, sha, unnest({_WIN}) AS s, len(l) AS n FROM l)
SELECT path AS relative_path, 'window' AS chunk_type, (s + 1)::INT AS start_line, least(s + 20, n)::INT AS end_line, sha AS file_sha256 FROM w
UNION ALL SELECT path, 'file_summary', NULL, NULL, sha FROM f UNION ALL SELECT DISTINCT folder, 'folder_summary', NULL, NULL, NULL FROM f UNION ALL SELECT 'project_map', 'project_map', NULL, NULL, NULL""")
def index_points(spark, sf):
    """An index of older texts of the labelled documents, with some that are gone since, is renewed to all documents."""
    files, labels = _files(spark, sf), table(spark, sf, "labels")
    old = files.join(labels.select("doc_id", "quality").distinct(), "doc_id", "left_semi")
    bad = labels.where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    old = old.join(bad, "doc_id", "left").withColumn("content", F.when(F.col("bad"), F.concat("content", F.lit("\nold"))).otherwise(F.col("content"))).withColumn("sha256", F.sha2("content", 256))
    gone = old.where("bad").withColumn("path", F.concat(F.lit("gone/"), "path"))
    old = old.unionByName(gone).select("path", "language", "content", "sha256")
    none = old.limit(0)
    nothing = index.payloads(none, "/work/app")
    points, state, _ = index.renewed(old, none.select("path", "sha256"), nothing, "/work/app", 20, 5, _no_edges(files))
    points, state, _ = index.renewed(files.drop("doc_id"), state, checkpointed(points), "/work/app", 20, 5, _no_edges(files))
    return points.select("relative_path", "chunk_type", "start_line", "end_line", "file_sha256")


@query("index_report", f"""WITH f AS ({_SCAN}), b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), o AS (SELECT f.doc_id, b.doc_id IS NOT NULL AS bad FROM f JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) LEFT JOIN b ON b.doc_id = f.doc_id)
SELECT count(*) AS scanned, count(*) - count(*) FILTER (NOT bad) AS reindexed, count(*) FILTER (NOT bad) AS unchanged, count(*) FILTER (bad) AS removed FROM f LEFT JOIN o USING (doc_id)""")
def index_report(spark, sf):
    files, labels = _files(spark, sf), table(spark, sf, "labels")
    bad = labels.where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    state = files.join(labels.select("doc_id").distinct(), "doc_id").join(bad, "doc_id", "left")
    gone = state.where("bad").select(F.concat(F.lit("gone/"), "path").alias("path"), "sha256")
    state = state.select("path", F.when(F.col("bad"), "older").otherwise(F.col("sha256")).alias("sha256")).unionByName(gone)
    return index.renewed(files.drop("doc_id"), state, index.payloads(files.limit(0).drop("doc_id"), "/work/app"), "/work/app", edges=_no_edges(files))[2]


@query("folder_summaries", "SELECT source AS folder, md5('Folder: ' || source || chr(10) || 'Contains:' || chr(10) || string_agg('- ' || source || '/' || doc_id || '.txt', chr(10) ORDER BY source || '/' || doc_id || '.txt')) AS content_md5 FROM documents GROUP BY 1")
def folder_summaries(spark, sf):
    return index.folder_rows(_files(spark, sf), "/work/app").select(F.col("relative_path").alias("folder"), F.md5("content").alias("content_md5"))


@query("project_identities", "SELECT doc_id, substr(sha256(p), 1, 24) AS project_id, source || '.x' AS project_name, p AS project_path FROM (SELECT doc_id, source, '/work/' || lang || '/' || source || '.x' AS p FROM documents)")
def project_identities(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("/work/./tmp\\..//"), "lang", F.lit("/old/../"), "source", F.lit(".x/"))
    return d.select("doc_id", index.identity(path).alias("i")).select("doc_id", "i.*")


@query("embedding_texts", "SELECT doc_id, md5(source || '/' || doc_id || CASE WHEN lang = 'en' THEN chr(10) || 'name' ELSE '' END || chr(10) || 'window' || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END) AS text_md5 FROM documents")
def embedding_texts(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return d.select("doc_id", F.md5(index.embedding_text(path, F.when(F.col("lang") == "en", "name"), F.lit(""), F.lit("window"), "text")).alias("text_md5"))


@query("capped_neighbors", f"{_EDGES}, b AS (SELECT src AS k, dst AS v FROM e UNION SELECT dst, src FROM e), k AS (SELECT k AS path FROM b GROUP BY 1), l(f, p, v) AS (SELECT 'i', src, list(dst ORDER BY dst)[1:3] FROM e GROUP BY src UNION ALL SELECT 'b', dst, list(src ORDER BY src)[1:3] FROM e GROUP BY dst UNION ALL SELECT 'n', k, list(v ORDER BY v)[1:3] FROM b GROUP BY k) SELECT path, " + ", ".join(f"coalesce((SELECT array_to_string(v, ' ') FROM l WHERE f = '{f}' AND p = path), '') AS {n}" for f, n in (("i", "imports"), ("b", "imported_by"), ("n", "neighbors"))) + " FROM k")
def capped_neighbors(spark, sf):
    edges = _edges(spark, sf).withColumn("relation", F.lit("FILE_IMPORTS_FILE"))
    held = index.adjacency(edges, index.CAPS | {"dependency_neighbors": 3})
    return held.select("path", *[F.array_join(c, " ").alias(c) for c in ("imports", "imported_by", "neighbors")])


@query("workspace_summary", """WITH f AS (SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'typescript' WHEN 'fr' THEN 'rust' ELSE 'markdown' END AS language FROM documents),
c AS (SELECT language, count(*) AS n FROM f GROUP BY 1) SELECT 'FastAPI,Node.js,Python,React,Rust' AS project_types, 'FastAPI,React' AS frameworks, true AS mixed,
'FastAPI, Node.js, Python, React, Rust. Frameworks: FastAPI, React. Languages: ' || string_agg(language || '=' || n, ', ' ORDER BY n DESC, language) || '.' AS summary FROM c""")
def workspace_summary(spark, sf):
    lang = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "typescript").when(F.col("lang") == "fr", "rust").otherwise("markdown")
    files = table(spark, sf, "documents").select(lang.alias("language"))
    known = readers.manifest_facts(spark.createDataFrame([("web/package.json", '{"dependencies": {"react": "18"}}'), ("requirements.txt", "fastapi>=0.1\n# note\nnumpy")], "path string, content string"))
    return graph.workspace(files, known).select(F.array_join("project_types", ",").alias("project_types"), F.array_join("frameworks", ",").alias("frameworks"), "mixed", "summary")


# Verification

_WANTED = [
    ("rows", "all", 100, None), ("fields", "missing.input", None, 0), ("fields", "missing.metadata", None, 0), ("fields", "blank.input", None, 0), ("fields", "blank.output", None, 0), ("fields", "untagged", None, 0),
    ("leakage", "ids", None, 0), *verify.split_bounds(), *[("objectives", o, 10, 100_000) for o in OBJECTIVES], ("spot", "objective", None, 0), ("spot", "output", None, 0), ("downloads", "none", 1, None),
]
_OF = "CASE WHEN language = 'en' THEN 'train' WHEN language = 'de' THEN 'val' ELSE 'test' END"


def _split_records(spark, sf):
    split = F.when(F.col("language") == "en", "train").when(F.col("language") == "de", "val").otherwise("test")
    return records(spark, sf).withColumn("split", split)


def _checks(spark, sf):
    df = _split_records(spark, sf)
    facts = verify.corpus_facts(df, list(OBJECTIVES)).unionByName(verify.spot_checks(df, "id"))
    facts = facts.unionByName(verify.table_facts(df.groupBy("repo").agg(F.count("*").alias("n")), "downloads", "repo", "n"))
    return verify.checked(facts, verify.bounds(spark, _WANTED))


_MEASURED = f"""m AS (SELECT *, {_OF} AS split FROM {_R}), t AS (SELECT count(*) AS n FROM m),
g(section, name, actual) AS (SELECT 'rows', 'all', n::DOUBLE FROM t UNION ALL SELECT 'fields', 'missing.input', count(*) FILTER (input IS NULL) FROM m UNION ALL SELECT 'fields', 'missing.metadata', n FROM t
 UNION ALL SELECT 'fields', 'blank.input', count(*) FILTER (trim(input) = '') FROM m UNION ALL SELECT 'fields', 'blank.output', n FROM t UNION ALL SELECT 'fields', 'untagged', count(*) FILTER (coalesce(NOT starts_with(input, '[TASK: ' || objective || ']'), true)) FROM m
 UNION ALL SELECT 'leakage', 'ids', (SELECT count(*) FROM (SELECT id FROM m GROUP BY id HAVING count(DISTINCT split) > 1))
 UNION ALL SELECT 'splits', s, (SELECT count(*) FROM m WHERE split = s) / n::DOUBLE FROM t, (VALUES ('train'), ('val'), ('test')) v(s)
 UNION ALL SELECT 'objectives', o, (SELECT count(*) FROM m WHERE objective = o) FROM (VALUES {", ".join(f"('{o}')" for o in OBJECTIVES)}) v(o)
 UNION ALL SELECT 'spot', 'objective', 0 UNION ALL SELECT 'spot', 'output', least(25, n) FROM t),
w(section, name, low, high) AS (VALUES {", ".join(f"('{s}', '{n}', {'NULL' if a is None else a}::DOUBLE, {'NULL' if b is None else b}::DOUBLE)" for s, n, a, b in _WANTED)}),
c AS (SELECT section, name, actual, actual IS NOT NULL AND coalesce(actual >= low, true) AND coalesce(actual <= high, true) AS ok FROM w LEFT JOIN g USING (section, name))"""


@query("verify_corpus", f"WITH {_MEASURED} SELECT section, name, round(actual, 6) AS actual, ok FROM c")
def verify_corpus(spark, sf):
    return _checks(spark, sf).select("section", "name", F.round("actual", 6).alias("actual"), "ok")


@query("verify_verdict", f"WITH {_MEASURED} SELECT bool_and(ok) AS ready, count(*) FILTER (NOT ok) AS failed, string_agg(section || '.' || name, ',' ORDER BY section || '.' || name) FILTER (NOT ok) AS blockers FROM c")
def verify_verdict(spark, sf):
    return rules.verdict(_checks(spark, sf))


@query("line_tolerance", "SELECT lang AS name, count(*)::DOUBLE AS actual, count(*) BETWEEN 300 * 0.95 AND 300 * 1.05 AS ok FROM documents GROUP BY 1 UNION ALL SELECT 'xx', NULL, false")
def line_tolerance(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    names = [r[0] for r in d.select("lang").collect()]
    return verify.checked(verify.table_facts(d, "lines", "lang", "n"), verify.bounds(spark, verify.line_bounds({k: 300 for k in [*names, "xx"]}))).select("name", "actual", "ok")


@query("rewrite_checks", "SELECT * FROM (VALUES ('good', 'rows', true), ('good', 'keys', true), ('good', 'props', true), ('lost', 'rows', true), ('lost', 'keys', false), ('lost', 'props', false)) t(case_name, name, ok)")
def rewrite_checks(spark, sf):
    """Events whose JSON is rewritten; and a rewrite that loses the smallest id, doubles another, and renames the key of one."""
    e = table(spark, sf, "events").select("event_id", "props")
    least, most = e.agg(F.min("event_id"), F.max("event_id")).first()
    good = e.withColumn("props", F.to_json(F.from_json("props", "map<string,bigint>")))
    last = e.where(F.col("event_id") == most)
    lost = good.where(F.col("event_id") != least).unionByName(last.withColumn("props", F.lit('{"q": 1}')))
    made = [verify.kept_rows(e, x, "event_id", "props", ["k"]).select(F.lit(n).alias("case_name"), "name", "ok") for n, x in (("good", good), ("lost", lost))]
    return made[0].unionByName(made[1])


@query("ingest_report", f"""WITH v AS (SELECT lang AS dataset, doc_id, CASE WHEN trim(text) = '' THEN 'pipeline_blank_input' END AS r FROM documents WHERE lang IN ('en', 'de')),
k AS (SELECT *, CASE WHEN r IS NULL AND dataset = 'en' AND count(*) FILTER (r IS NULL) OVER (PARTITION BY dataset ORDER BY doc_id) > 50 THEN 'max_per_dataset_cap' ELSE r END AS reason FROM v),
s AS (SELECT dataset, 'success' AS status, count(*) AS raw, count(*) FILTER (reason IS NULL) AS kept, count(reason) AS dropped, round(count(*) FILTER (reason IS NULL) / count(*)::DOUBLE, 6) AS retention, count(*) FILTER (reason = 'max_per_dataset_cap') AS over FROM k GROUP BY 1)
SELECT * FROM s UNION ALL SELECT * FROM (VALUES ('gone', 'missing_raw', 0, 0, 0, 0.0, 0), ('broken', 'load_failed', 0, 0, 0, 0.0, 0), ('odd', 'converter_error', 0, 0, 0, 0.0, 0), ('other', 'skipped', 0, 0, 0, 0.0, 0))""")
def ingest_report(spark, sf):
    rows = records(spark, sf).withColumns({"output": F.lit("x"), "metadata": F.create_map(F.lit("k"), F.lit("v"))})
    same = lambda df: df
    sources = {
        "en": shape.Source(rows.where("language = 'en'"), same, "code_gen", 50), "de": shape.Source(lambda: rows.where("language = 'de'"), same, "bug_fix"), "gone": shape.Source(None, same, "code_gen"),
        "broken": shape.Source(lambda: spark.read.parquet(f"{sf}/there-is-none.parquet"), same, "code_gen"), "odd": shape.Source(rows, lambda df: df.select("no_such_column"), "code_gen"), "other": shape.Source(rows, same, "poetry"),
    }
    report = shape.ingest(spark, sources, list(OBJECTIVES))[1]
    return report.select("dataset", "status", "raw", "kept", "dropped", "retention", F.coalesce(F.try_element_at("reasons", F.lit(shape.CAP_REASON)), F.lit(0)).alias("over"))


# Filters of streams and files

@query("utf8_bytes", "SELECT doc_id, octet_length(encode(text)) <= 50 OR substr(hex(encode(text)), 101, 1) NOT IN ('8', '9', 'A', 'B') AS whole FROM documents WHERE text IS NOT NULL")
def utf8_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", filters.encodable(F.substring(F.encode("text", "UTF-8"), 1, 50)).alias("whole"))


@query("stream_gates", """SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported_language' WHEN lang NOT IN ('en', 'fr') THEN 'not_included' WHEN length(text) > 5000 THEN 'max_chars_exceeded'
 WHEN NOT (contains(lower(text), 'function ') OR contains(lower(text), 'class ') OR contains(text, '=>') OR contains(lower(text), 'def ') OR contains(lower(text), 'public ') OR contains(lower(text), 'private ') OR contains(lower(text), 'protected ') OR contains(lower(text), '#include')) THEN 'not_snippet_like' END AS reason FROM documents) GROUP BY 1""")
def stream_gates(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("language"), F.col("text").alias("code"))
    return filters.counts_by_reason(filters.stream_gates(d, ["en", "de", "fr"], ["EN", "fr"], True, 5000, True))


@query("selected_files", "SELECT path, how FROM (SELECT 'data/' || lang || '/' || source || '/' || doc_id || '.jsonl' AS path, lang FROM documents), (VALUES ('folder'), ('part')) v(how) WHERE lang IN ('en', 'de')")
def selected_files(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("data/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jsonl")).alias("path"))
    listing = d.unionByName(d.select(F.replace("path", F.lit(".jsonl"), F.lit(".parquet")).alias("path"))).unionByName(d.select(F.replace("path", F.lit("data/"), F.lit("da-")).alias("path")))
    one = readers.select_files(listing, ["en", "DE"], folder="data").withColumn("how", F.lit("folder"))
    return one.unionByName(readers.select_files(listing.where(F.col("path").startswith("data/")), ["en", "de"]).withColumn("how", F.lit("part")))


@query("nth_row", "SELECT doc_id, text FROM documents WHERE doc_id = 41")
def nth_row(spark, sf):
    return readers.nth(table(spark, sf, "documents"), 41, "doc_id").select("doc_id", "text")


@query("raw_dir_indirection", "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'dir_' || r_name ELSE n_name END AS raw_dir FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'dir_' || r_name FROM region")
def raw_dir_indirection(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    of = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    configs = of.select(F.col("n_name").alias("name"), F.lit("").alias("raw_dir_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).alias("reuse_raw_from"))
    return readers.raw_dir(configs.unionByName(r.select(F.col("r_name").alias("name"), F.concat(F.lit("dir_"), "r_name").alias("raw_dir_name"), F.lit(None).cast("string").alias("reuse_raw_from"))))
