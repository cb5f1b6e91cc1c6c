"""Queries of code intelligence: chunks, references, graphs, importance; and streams that equal their batch twins."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as X
from ..operators import chunk, filters, graph, output, rules
from ..session import scratch, table
from ..streaming import keyed, streams
from .registry import query

_LINES = "CASE WHEN t = '' THEN [] WHEN t LIKE '%' || chr(10) THEN string_split(t[1:length(t) - 1], chr(10)) ELSE string_split(t, chr(10)) END"


@query("line_windows", f"""WITH d AS (SELECT doc_id, {_LINES} AS l FROM (SELECT doc_id, text AS t FROM documents)),
s AS (SELECT doc_id, l, unnest(range(0, len(l), 15)) AS s FROM d)
SELECT doc_id, s + 1 AS start_line, least(s + 20, len(l)) AS end_line, md5(array_to_string(l[s + 1:s + 20], chr(10))) AS chunk_md5 FROM s WHERE s = 0 OR s - 15 + 20 < len(l)""")
def line_windows(spark, sf):
    held = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return chunk.line_windows(held, size=20, overlap=5).select("doc_id", "start_line", "end_line", F.md5("chunk").alias("chunk_md5"))


@query("markdown_sections", f"""WITH d AS (SELECT doc_id, {_LINES} AS l FROM (SELECT doc_id, regexp_replace(text, '(^|\\n)(T[a-z]*)', '\\1## \\2', 'g') AS t FROM documents)),
h AS (SELECT doc_id, l, unnest(list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '#'))) AS a FROM d),
e AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1, len(l)) AS b FROM h)
SELECT doc_id, a AS start_line, b AS end_line, substr(trim(ltrim(l[a], '#')), 1, 80) AS title FROM e""")
def markdown_sections(spark, sf):
    held = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "(^|\\n)(T[a-z]*)", "$1## $2").alias("content"))
    return chunk.sections(held).select("doc_id", "start_line", "end_line", "title")


@query("line_counts", f"SELECT doc_id, len({_LINES})::BIGINT AS loc, len(list_filter({_LINES}, lambda x: trim(x) <> ''))::BIGINT AS filled FROM (SELECT doc_id, text AS t FROM documents)")
def line_counts(spark, sf):
    lines = X.lines("text")
    return table(spark, sf, "documents").select("doc_id", F.size(lines).cast("long").alias("loc"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("filled"))


# Pages as files: a page's host is its module, and its links are references

_HREF = "list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))"
_EDGES = f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, {_HREF} AS refs FROM pages),
e AS (SELECT DISTINCT host AS src, r AS dst FROM (SELECT host, unnest(refs) AS r FROM p))"""


def _refs(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("refs"))


def _edges(spark, sf):
    return _refs(spark, sf).select(F.col("host").alias("src"), F.explode("refs").alias("dst")).distinct()


@query("import_refs_pages", f"{_EDGES} SELECT page_id, host, len(refs)::INT AS n, array_to_string(list_sort(refs), ' ') AS refs FROM p")
def import_refs_pages(spark, sf):
    return _refs(spark, sf).select("page_id", "host", F.size("refs").alias("n"), F.array_join(F.array_sort("refs"), " ").alias("refs"))


_DEGREES = f"{_EDGES}, n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e), g AS (SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, sum(o + i)::BIGINT AS degree FROM n GROUP BY 1)"


@query("link_graph_degree", f"{_DEGREES} SELECT * FROM g")
def link_graph_degree(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query("module_degree", f"{_DEGREES} SELECT coalesce(nullif(regexp_extract(node, '^(.*)/[^/]*$', 1), ''), '(root)') AS module, sum(degree)::BIGINT AS degree FROM g GROUP BY 1")
def module_degree(spark, sf):
    return graph.module_degrees(_edges(spark, sf))


@query("top_hotspots", f"{_DEGREES} SELECT node, degree FROM g WHERE n_in > 0 ORDER BY degree DESC, node LIMIT 8")
def top_hotspots(spark, sf):
    return graph.hotspots(_edges(spark, sf), 8)


@query("reverse_neighbors", f"{_EDGES} SELECT dst AS node, count(*) AS n, array_to_string(list(src ORDER BY src)[1:15], ' ') AS sources FROM e GROUP BY 1")
def reverse_neighbors(spark, sf):
    return graph.importers(_edges(spark, sf)).withColumn("sources", F.array_join("sources", " "))


@query("edge_counts", f"{_EDGES} SELECT CASE WHEN dst LIKE '/%' THEN 'FILE_IMPORTS_FILE' ELSE 'FILE_IMPORTS_HOST' END AS relation, count(*) AS n FROM e GROUP BY 1")
def edge_counts(spark, sf):
    relation = F.when(F.col("dst").startswith("/"), "FILE_IMPORTS_FILE").otherwise("FILE_IMPORTS_HOST")
    return rules.counts(_edges(spark, sf).withColumn("relation", relation), "relation")


@query("folder_listing", f"{_EDGES} SELECT host, count(*) AS n, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS pages FROM p GROUP BY 1")
def folder_listing(spark, sf):
    held = _refs(spark, sf).groupBy("host").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("page_id")).alias("p"))
    return held.select("host", "n", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


@query("importance_score", """SELECT page_id, round(least(i * 0.22, 1.2) + least(o * 0.08, 0.5) + least(s * 0.05, 0.5) + CASE WHEN page_id % 9 = 0 THEN 1.0 ELSE 0 END + CASE WHEN page_id % 4 = 0 THEN 0.35 ELSE 0 END
 + CASE WHEN page_id % 5 = 0 THEN 0.2 ELSE 0 END + CASE WHEN page_id % 6 = 0 THEN 0.1 ELSE 0 END + CASE WHEN page_id % 8 = 0 THEN 0.25 ELSE 0 END, 4)::DOUBLE AS score FROM (SELECT page_id, page_id % 7 AS i, page_id % 11 AS o, page_id % 13 AS s FROM pages)""")
def importance_score(spark, sf):
    i = F.col("page_id")
    path = F.when(i % 8 == 0, "docs/README.md").otherwise("src/a.py")
    p = table(spark, sf, "pages")
    return p.select("page_id", C.importance(path, i % 11, i % 7, i % 13, i % 9 == 0, i % 4 == 0, i % 5 == 0, i % 6 == 0).cast("double").alias("score"))


@query("called_functions_regex", "SELECT page_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(html, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)), lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'catch', 'function', 'return', 'class', 'def', 'fn', 'new'))), ',') AS names FROM pages")
def called_functions_regex(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(C.called_names("html")), ",").alias("names"))


_COUNTED = " + ".join("len(regexp_extract_all(html, '{}'))".format(p.replace("'", "''")) for p in C.SYMBOL_COUNT)


@query("symbol_counts", f"SELECT page_id, ({_COUNTED})::BIGINT AS n FROM pages")
def symbol_counts(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.symbol_count("html").alias("n"))


@query("file_language", "SELECT page_id, ['python', 'rust', 'yaml', 'dockerfile', 'json'][1 + page_id % 5] AS language FROM pages")
def file_language(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in ("a/b.PY", "src/x.rs", "compose.yml", "Dockerfile", "LICENSE")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", C.language(name, F.lit('{"a": 1}')).alias("language"))


@query("path_classes", "SELECT page_id, page_id % 4 = 0 AS test, page_id % 4 = 1 AS config, page_id % 4 = 2 AS doc FROM pages")
def path_classes(spark, sf):
    path = F.element_at(F.array(*[F.lit(n) for n in ("pkg/tests/test_a.py", "setup.cfg", "README.md", "src/run.py")]), (F.col("page_id") % 4 + 1).cast("int"))
    lang = C.language(path, F.lit(""))
    return table(spark, sf, "pages").select("page_id", C.is_test(path).alias("test"), C.is_config(path, lang).alias("config"), C.is_doc(path, lang).alias("doc"))


_CODE = """(SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'cpp' WHEN 4 THEN 'csharp' ELSE 'rust' END AS language,
 'import java.util.' || host || ';' || chr(10) || 'from .' || host || ' import x, flask' || chr(10) || '#include <' || host || '.h>' || chr(10) || 'using Sys.' || host || ';' || chr(10) || 'use a::' || host || chr(10) || 'const e = require("./' || host || '/x"); express()' || chr(10) || 'import os' || chr(10) || html AS content
 FROM (SELECT page_id, html, regexp_replace(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '[^a-z]', '', 'g') AS host FROM pages))"""


def _code(spark, sf):
    """Pages as source files: imports of all languages before each page's own text."""
    p = table(spark, sf, "pages").withColumn("host", F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), "[^a-z]", ""))
    language = F.element_at(F.array(*[F.lit(x) for x in ("python", "javascript", "java", "cpp", "csharp", "rust")]), (F.col("page_id") % 6 + 1).cast("int"))
    parts = ["import java.util.", "host", ";\nfrom .", "host", " import x, flask\n#include <", "host", ".h>\nusing Sys.", "host", ";\nuse a::", "host", '\nconst e = require("./', "host", '/x"); express()\nimport os\n', "html"]
    return p.select("page_id", language.alias("language"), F.concat(*[F.col(x) if x in ("host", "html") else F.lit(x) for x in parts]).alias("content"))


def _found(language: str) -> str:
    every = " || ".join("regexp_extract_all(content, '{}', 1)".format(p.replace("'", "''")) for p in C.REFERENCES[language])
    last = {"java": "string_split(x, '.')[-1]", "csharp": "string_split(x, '.')[-1]", "rust": "replace(x, '::', '/')"}.get(language, "x")
    return f"WHEN '{language}' THEN list_transform({every}, lambda x: {last})"


@query("import_references", f"WITH r AS (SELECT page_id, CASE language {' '.join(_found(x) for x in ('python', 'javascript', 'java', 'cpp', 'csharp', 'rust'))} END AS r FROM {_CODE}) SELECT page_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i)[1:100], ' ') AS refs FROM r")
def import_references(spark, sf):
    return _code(spark, sf).select("page_id", F.array_join(C.references("content", "language"), " ").alias("refs"))


_NAMES = ", ".join("nullif(regexp_extract(content, '{}', 1), '')".format(p.replace("'", "''")) for p in C.SYMBOL_NAME)


@query("symbol_names", f"SELECT page_id, coalesce({_NAMES}) AS name FROM {_CODE}")
def symbol_names(spark, sf):
    return _code(spark, sf).select("page_id", C.symbol_name("content").alias("name"))


@query("frameworks_found", f"SELECT page_id, CASE language WHEN 'python' THEN 'Flask' WHEN 'javascript' THEN 'Express' ELSE '' END || CASE WHEN language = 'python' AND contains(lower(content), 'django') THEN ',Django' ELSE '' END AS frameworks FROM {_CODE}")
def frameworks_found(spark, sf):
    return _code(spark, sf).select("page_id", F.array_join(C.frameworks("content", "language"), ",").alias("frameworks"))


_SHOWN = "ltrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("content_language", f"""SELECT doc_id, CASE WHEN starts_with(s, '# ') OR starts_with(s, '## ') THEN 'markdown' WHEN starts_with(s, '{{') OR starts_with(s, '[') THEN 'json' WHEN starts_with(s, 'FROM ') OR contains(t, chr(10) || 'RUN ') THEN 'dockerfile'
 WHEN contains(t, 'fn ') AND (contains(t, 'let ') OR contains(t, 'use ')) THEN 'rust' WHEN starts_with(s, 'using ') OR contains(s, 'namespace ') THEN 'csharp' WHEN contains(t, '#include') OR contains(t, 'std::') THEN 'cpp' WHEN contains(t, 'public class ') THEN 'java'
 WHEN contains(t, 'function ') OR contains(t, 'const ') OR contains(t, 'let ') THEN 'javascript' ELSE 'python' END AS language
 FROM (SELECT doc_id, t, {_SHOWN} AS s FROM (SELECT doc_id, ['# ', '  {{"a": 1}} ', 'FROM x ', 'fn a use b ', 'using y; ', 'int std::z ', 'public class Q ', 'const k = 1; ', '', 'x ' || chr(10) || 'RUN '][1 + doc_id % 10] || text AS t FROM documents))""")
def content_language(spark, sf):
    """Files whose names say nothing, by signs at their start and in their own texts."""
    starts = ("# ", '  {"a": 1} ', "FROM x ", "fn a use b ", "using y; ", "int std::z ", "public class Q ", "const k = 1; ", "", "x \nRUN ")
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in starts]), (F.col("doc_id") % 10 + 1).cast("int")), "text")
    return table(spark, sf, "documents").select("doc_id", C.language(F.lit("LICENSE"), text).alias("language"))


# Source trees of several languages, made of the documents: each document's words are a comment in its files

#: kind: language, path before and after the number, content. {n} is a document's number, {p} half of it, {t} its words.
MADE = {
    "py": ("python", "app/m{n}.py", "# {t}\nimport os\nfrom app.m{p} import f{p}\n\n\nclass C{n}(C{p}):\n    def run{n}(self):\n        return f{p}(os.getcwd())\n\n\ndef f{n}(x):\n    return x\n"),
    "js": ("javascript", "web/j{n}.js", "// {t}\nimport { g{p} } from './j{p}';\napp.get('/r{n}', g{n});\nfunction g{n}(a) {\n  return g{p}(a);\n}\n"),
    "test": ("python", "tests/test_m{n}.py", "from app.m{n} import f{n}\n\n\ndef test_f{n}():\n    assert f{n}(1) == 1\n"),
    "rs": ("rust", "core/r{n}.rs", "// {t}\nuse crate::r{p};\nstruct S{n} { x: i32 }\nimpl D{n} for S{n} {\n  fn draw{n}(&self) { println!(\"}\"); }\n}\nfn main() {\n  go{n}();\n}\n"),
    "md": ("markdown", "docs/d{n}/README.md", "# Title {n}\n{t}\n## Use\nmore\n"),
    "api": ("python", "api/a{n}.py", "# {t}\nfrom fastapi import FastAPI\n\napp = FastAPI()\n\n\n@app.get('/u{n}')\nasync def list{n}():\n    return []\n"),
}
_EVERY = ["py", "js"]
_FOURTH = ["test", "rs", "md", "api"]


def _files(spark, sf):
    """path, language, content: a Python and a JavaScript file for each document, and a test, Rust, Markdown or API file by doc_id % 4."""
    n, p, t = F.col("n"), F.col("p"), F.col("t")
    # columns of their own: in the rows' structs they would be worked out once for each place they stand in
    held = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("n"), F.floor(F.col("doc_id") / 2).cast("string").alias("p"), F.regexp_replace("text", "[^A-Za-z]+", " ").alias("t"))

    def filled(template):
        parts = re.split(r"(\{[npt]\})", template)
        return F.concat(*[{"{n}": n, "{p}": p, "{t}": t}.get(x, F.lit(x)) for x in parts if x])

    made = {k: F.struct(filled(path).alias("path"), F.lit(language).alias("language"), filled(content).alias("content")) for k, (language, path, content) in MADE.items()}
    last = made[_FOURTH[-1]]
    for i, k in enumerate(_FOURTH[:-1]):
        last = F.when(F.col("doc_id") % 4 == i, made[k]).otherwise(last)
    return held.select(F.explode(F.array(*[made[k] for k in _EVERY], last)).alias("f")).select("f.*")


def _made_sql() -> str:
    def filled(template):
        parts = [x for x in re.split(r"(\{[npt]\})", template) if x]
        return " || ".join({"{n}": "n", "{p}": "p", "{t}": "t"}.get(x, "'" + x.replace("'", "''") + "'") for x in parts)

    rows = [f"SELECT '{k}' AS kind, n, p, {filled(path)} AS path, '{language}' AS language, {filled(content)} AS content FROM d" + ("" if k in _EVERY else f" WHERE n % 4 = {_FOURTH.index(k)}") for k, (language, path, content) in MADE.items()]
    return "d AS (SELECT doc_id AS n, doc_id // 2 AS p, regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS t FROM documents), f AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")"


_F = _made_sql()
_DEFINED = """u AS (SELECT path, n, unnest(CASE kind WHEN 'py' THEN ['f' || n, 'run' || n] WHEN 'js' THEN ['g' || n] WHEN 'test' THEN ['test_f' || n] WHEN 'rs' THEN ['draw' || n, 'main'] WHEN 'api' THEN ['list' || n] ELSE [] END) AS name FROM f)"""
_IMPORTS = """i AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM f a JOIN f b ON (a.kind = b.kind AND a.kind IN ('py', 'js', 'rs') AND b.n = a.p) OR (a.kind = 'test' AND b.kind = 'py' AND a.n = b.n) WHERE a.path <> b.path)"""
_SIGNALS = f"""g AS (SELECT path, language, kind, n, (SELECT count(*) FROM i WHERE src = path) AS import_count, (SELECT count(*) FROM i WHERE dst = path) AS imported_by_count,
 ({" + ".join("len(regexp_extract_all(content, '{}'))".format(x.replace("'", "''")) for x in C.SYMBOL_COUNT)})::BIGINT AS symbol_count, kind = 'rs' AS is_entry_point, false AS is_config_file, kind = 'md' AS is_doc_file, kind = 'test' AS is_test_file,
 if(kind = 'api', 'FastAPI', '') AS frameworks FROM f),
k AS (SELECT * EXCLUDE (kind, n), round(least(imported_by_count * 0.22, 1.2) + least(import_count * 0.08, 0.5) + least(symbol_count * 0.05, 0.5) + if(is_entry_point, 1.0, 0) + if(is_doc_file, 0.2, 0) + if(is_test_file, 0.1, 0) + if(kind = 'md', 0.25, 0), 4)::DOUBLE AS importance_score FROM g)"""


@query("symbol_chunks", f"""WITH {_F} SELECT path, c.k AS chunk_type, c.s AS symbol, c.a AS start_line, c.b AS end_line FROM (SELECT path, unnest(CASE kind
 WHEN 'py' THEN [{{'k': 'class', 's': 'C' || n, 'a': 6, 'b': 8}}, {{'k': 'function', 's': 'f' || n, 'a': 11, 'b': 12}}] WHEN 'js' THEN [{{'k': 'function', 's': 'g' || n, 'a': 4, 'b': 6}}] WHEN 'test' THEN [{{'k': 'function', 's': 'test_f' || n, 'a': 4, 'b': 5}}]
 WHEN 'rs' THEN [{{'k': 'class', 's': 'S' || n, 'a': 3, 'b': 3}}, {{'k': 'class', 's': 'D' || n, 'a': 4, 'b': 6}}, {{'k': 'function', 's': 'main', 'a': 7, 'b': 9}}]
 WHEN 'md' THEN [{{'k': 'doc_section', 's': 'Title ' || n, 'a': 1, 'b': 2}}, {{'k': 'doc_section', 's': 'Use', 'a': 3, 'b': 4}}] ELSE [{{'k': 'function', 's': 'list' || n, 'a': 8, 'b': 9}}] END) AS c FROM f)""")
def symbol_chunks(spark, sf):
    return chunk.symbol_chunks(_files(spark, sf)).select("path", "chunk_type", "symbol", "start_line", "end_line")


@query("structures", f"""WITH {_F} SELECT path, CASE kind WHEN 'py' THEN 'C' || n || '(C' || p || ')' WHEN 'rs' THEN 'S' || n || '(),S' || n || '(D' || n || ')' ELSE '' END AS classes,
 CASE kind WHEN 'py' THEN 'f' || n || ',run' || n WHEN 'js' THEN 'g' || n WHEN 'test' THEN 'test_f' || n WHEN 'rs' THEN 'draw' || n || ',main' WHEN 'api' THEN 'list' || n ELSE '' END AS functions FROM f""")
def structures(spark, sf):
    held = _files(spark, sf).select("path", C.structure_of("content", "language").alias("s"))
    return held.select("path", F.array_join(F.transform("s.classes", lambda c: F.concat(c["name"], F.lit("("), F.array_join(c["bases"], " "), F.lit(")"))), ",").alias("classes"), F.array_join("s.functions", ",").alias("functions"))


@query("api_routes", f"WITH {_F} SELECT path, 'GET' AS method, if(kind = 'js', '/r', '/u') || n AS route, if(kind = 'js', 'g', 'list') || n AS handler FROM f WHERE kind IN ('js', 'api')")
def api_routes(spark, sf):
    return _files(spark, sf).select("path", F.explode(C.routes("content", "language")).alias("r")).select("path", "r.method", F.col("r.path").alias("route"), "r.handler")


@query("dependency_graph", f"""WITH {_F}, {_DEFINED}, {_IMPORTS}, homes AS (SELECT name, min(path) AS home FROM u GROUP BY 1 HAVING count(*) = 1),
calls AS (SELECT path, 'f' || p AS name FROM f WHERE kind = 'py' UNION ALL SELECT path, 'f' || n FROM f WHERE kind = 'test' UNION ALL SELECT path, 'g' || p FROM f WHERE kind = 'js' UNION ALL SELECT path, 'main' FROM f WHERE kind = 'rs'),
parent AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS module FROM f),
e AS (SELECT src, dst, 'FILE_IMPORTS_FILE' AS relation FROM i UNION ALL SELECT a.module, b.module, 'MODULE_DEPENDS_ON_MODULE' FROM i JOIN parent a ON a.path = src JOIN parent b ON b.path = dst
 UNION ALL SELECT 'C' || n, 'C' || p, 'CLASS_INHERITS_CLASS' FROM f WHERE kind = 'py' UNION ALL SELECT 'S' || n, 'D' || n, 'CLASS_INHERITS_CLASS' FROM f WHERE kind = 'rs' UNION ALL SELECT name, path, 'FUNCTION_BELONGS_TO_FILE' FROM u
 UNION ALL SELECT path, name, 'FUNCTION_CALLS_FUNCTION' FROM calls JOIN homes USING (name) WHERE path <> home
 UNION ALL SELECT f.path, 'app/m' || n || '.py', 'TEST_COVERS_FILE' FROM f WHERE kind = 'test' UNION ALL SELECT path, 'f' || n, 'TEST_COVERS_FUNCTION' FROM f WHERE kind = 'test'
 UNION ALL SELECT path, 'core', 'ENTRYPOINT_STARTS_MODULE' FROM f WHERE kind = 'rs' UNION ALL SELECT if(kind = 'js', 'GET /r', 'GET /u') || n, if(kind = 'js', 'g', 'list') || n, 'API_ROUTE_CALLS_HANDLER' FROM f WHERE kind IN ('js', 'api'))
SELECT DISTINCT src, dst, relation FROM e WHERE src <> dst""")
def dependency_graph(spark, sf):
    return graph.build(_files(spark, sf))


_LIST = "coalesce((SELECT string_agg(v, ',' ORDER BY r, v) FROM (SELECT v, min(r) AS r FROM {0} x WHERE x.path = f.path AND v <> f.path GROUP BY v)), '')"


@query("file_relations", f"""WITH {_F}, {_IMPORTS}, o AS (SELECT src AS path, 0 AS r, dst AS v FROM i), n AS (SELECT dst AS path, 1 AS r, src AS v FROM i),
t AS (SELECT 'app/m' || n || '.py' AS path, 2 AS r, path AS v FROM f WHERE kind = 'test'),
kin AS (SELECT a.path AS low, b.path AS high FROM f a JOIN f b ON a.kind = 'py' AND b.kind = 'py' AND b.n = a.p AND a.path <> b.path),
called AS (SELECT a.path, 5 AS r, b.path AS v FROM f a JOIN f b ON (a.kind = b.kind AND a.kind IN ('py', 'js') AND b.n = a.p) OR (a.kind = 'test' AND b.kind = 'py' AND a.n = b.n)),
lone AS (SELECT path, 5 AS r, (SELECT min(path) FROM f WHERE kind = 'rs') AS v FROM f WHERE kind = 'rs' AND (SELECT count(*) FROM f WHERE kind = 'rs') = 1),
a AS (SELECT * FROM o UNION ALL SELECT * FROM n UNION ALL SELECT * FROM t UNION ALL SELECT low, 3, high FROM kin UNION ALL SELECT high, 4, low FROM kin UNION ALL SELECT * FROM called UNION ALL SELECT * FROM lone),
s AS (SELECT path, unnest(range(5)) AS r, unnest(CASE kind WHEN 'py' THEN ['C' || n, 'f' || n, 'run' || n, 'C' || p, NULL] WHEN 'js' THEN ['g' || n, NULL, NULL, NULL, NULL] WHEN 'test' THEN ['test_f' || n, NULL, NULL, NULL, NULL] WHEN 'rs' THEN ['S' || n, 'draw' || n, 'main', 'D' || n, NULL] WHEN 'api' THEN ['list' || n, NULL, NULL, NULL, NULL] ELSE [NULL, NULL, NULL, NULL, NULL] END) AS v FROM f),
heirs AS (SELECT high AS path, 0 AS r, 'C' || regexp_extract(low, 'm([0-9]+)', 1) AS v FROM kin UNION ALL SELECT path, 0, 'C0' FROM f WHERE kind = 'py' AND n = 0)
SELECT path, {_LIST.format("o")} AS imports, {_LIST.format("n")} AS imported_by, {_LIST.format("a")} AS related_files, {_LIST.format("t")} AS related_tests, {_LIST.format("s")} AS related_symbols,
 (SELECT count(*) FROM (SELECT r, v FROM o WHERE o.path = f.path UNION SELECT r, v FROM n WHERE n.path = f.path)) AS dependency_count,
 CASE kind WHEN 'py' THEN 2 WHEN 'js' THEN if(n = p, 2, 3) WHEN 'test' THEN 1 WHEN 'rs' THEN 3 WHEN 'api' THEN 2 ELSE 0 END::BIGINT AS call_count,
 CASE kind WHEN 'py' THEN 'C' || n WHEN 'rs' THEN 'S' || n || ',S' || n ELSE '' END AS classes, CASE kind WHEN 'py' THEN 'f' || n || ',run' || n WHEN 'js' THEN 'g' || n WHEN 'test' THEN 'test_f' || n WHEN 'rs' THEN 'draw' || n || ',main' WHEN 'api' THEN 'list' || n ELSE '' END AS functions,
 CASE kind WHEN 'py' THEN 'C' || p WHEN 'rs' THEN 'D' || n ELSE '' END AS parent_classes, {_LIST.format("heirs")} AS child_classes FROM f""")
def file_relations(spark, sf):
    held = graph.relations(_files(spark, sf))
    return held.select("path", *[F.array_join(c, ",").alias(c) for c in ("imports", "imported_by", "related_files", "related_tests", "related_symbols")], "dependency_count", "call_count", *[F.array_join(c, ",").alias(c) for c in ("classes", "functions", "parent_classes", "child_classes")])


@query("file_signals", f"WITH {_F}, {_IMPORTS}, {_SIGNALS} SELECT * FROM k")
def file_signals(spark, sf):
    files = _files(spark, sf)
    return graph.signals(files, graph.resolve(files)).withColumn("frameworks", F.array_join("frameworks", ","))


@query("project_facts", f"""WITH {_F}, {_IMPORTS}, {_SIGNALS} SELECT 'Node.js,Python,Rust' AS project_types, 'FastAPI' AS frameworks,
 (SELECT string_agg(path, ',' ORDER BY importance_score DESC, path) FROM (SELECT * FROM k WHERE importance_score > 0 ORDER BY importance_score DESC, path LIMIT 80)) AS important_files, (SELECT string_agg(path, ',' ORDER BY path) FROM k WHERE is_entry_point) AS entry_points,
 (SELECT '{{' || string_agg('"' || language || '":' || n, ',' ORDER BY language) || '}}' FROM (SELECT language, count(*) AS n FROM f GROUP BY 1)) AS languages""")
def project_facts(spark, sf):
    files = _files(spark, sf)
    held = graph.project(graph.signals(files, graph.resolve(files)))
    return held.select(*[F.array_join(c, ",").alias(c) for c in ("project_types", "frameworks", "important_files", "entry_points")], F.to_json("languages").alias("languages"))


@query("import_lines", f"WITH {_F} SELECT path, CASE kind WHEN 'py' THEN 2 WHEN 'md' THEN 0 ELSE 1 END AS n FROM f")
def import_lines(spark, sf):
    return _files(spark, sf).select("path", F.size(C.import_lines("content", "language")).alias("n"))


_HIDING = {
    "java": ("/* ", " } ) \" */\nclass K{n} {\n  char c = '}'; // }\n}\n", r"\*/", 0),
    "cpp": ('const char* a = R"x(', ' } )x";\nstruct K{n} {\n  int n = 1\'000;\n};\n', r'\)x"', 0),
    "javascript": ("const a = `", " } ${b({c: `}`})} `;\nfunction K{n}(a) {\n  return /[}]/.test(a);\n}\n", r"[`$\\]", 0),
    "rust": ('const A: &str = r##"', ' } "# "##;\nfn K{n}(x: &str) {\n  /* } /* } */ */\n}\n', r'"##', 0),
}


@query("lexed_blocks", "WITH d AS (SELECT doc_id, doc_id % 4 AS i, ['\\*/', '\\)x\"', '[`$\\\\]', '\"##'][1 + doc_id % 4] AS p, text FROM documents), h AS (SELECT *, 2 + length(t) - length(replace(t, chr(10), '')) AS a FROM (SELECT doc_id, i, regexp_replace(text, p, '', 'g') AS t FROM d)) SELECT doc_id, if(i < 2, 'class', 'function') AS chunk_type, 'K' || doc_id AS symbol, a::INT AS start_line, (a + 2)::INT AS end_line, 0.0::DOUBLE AS errors FROM h")
def lexed_blocks(spark, sf):
    """Whole texts, with all the brackets and quotes they have, stand in comments and literals; blocks and bracket errors are those of the code around."""
    names = list(_HIDING)
    pick = lambda k: F.element_at(F.array(*[F.lit(_HIDING[x][k]) for x in names]), (F.col("doc_id") % 4 + 1).cast("int"))
    language = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % 4 + 1).cast("int"))
    hidden = F.lit(None)
    for i, x in enumerate(names):
        hidden = F.when(F.col("doc_id") % 4 == i, F.regexp_replace("text", _HIDING[x][2], "")).otherwise(hidden)
    content = F.concat(pick(0), hidden, F.replace(pick(1), F.lit("{n}"), F.col("doc_id").cast("string")))
    held = table(spark, sf, "documents").select("doc_id", language.alias("language"), content.alias("content"))
    blocks = chunk.symbol_chunks(held.withColumn("source", F.col("content")))
    errors = F.pandas_udf(lambda a, b: pd.Series([filters.error_ratio(x, y) for x, y in zip(a, b)]), "double")
    return blocks.select("doc_id", "chunk_type", "symbol", "start_line", "end_line", errors("language", "source").alias("errors"))


@query("test_counts", """WITH c AS (SELECT conv_id, conv_id % 7 AS a, count(*) AS b, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, 'pytest' AS framework, a + b + u + 1 AS run, a + 1 AS failed FROM c UNION ALL SELECT conv_id, 'npm', a + b, a FROM c UNION ALL SELECT conv_id, 'maven', a + b, a + u FROM c UNION ALL SELECT conv_id, 'dotnet', a + b + u, a FROM c UNION ALL SELECT conv_id, 'cargo', b + u + a + 1, a FROM c""")
def test_counts(spark, sf):
    """Outputs of test runs whose numbers are counts of the conversations."""
    held = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("b"), F.count_if(F.col("role") == "user").alias("u")).withColumn("a", F.col("conv_id") % 7)
    told = {
        "pytest": "{a} failed, {b} passed, 1 error, {u} skipped in 3s", "npm": "Tests: {a} failed, {b} passed, {a+b} total", "maven": "Tests run: 3, Failures: 0, Errors: 0\nTests run: {a+b}, Failures: {a}, Errors: {u}",
        "dotnet": "Failed: {a}, Passed: {b}, Skipped: {u}, Total: {a+b+u}", "cargo": "test result: ok. {b} passed; 0 failed\ntest result: FAILED. {u+1} passed; {a} failed",
    }
    filled = lambda t: F.concat(*[F.expr(x[1:-1]).cast("string") if x[0] == "{" else F.lit(x) for x in re.split(r"(\{[^}]*\})", t) if x])
    runs = F.explode(F.array(*[F.struct(F.lit(k).alias("framework"), filled(t).alias("output")) for k, t in told.items()]))
    return held.select("conv_id", runs.alias("r")).select("conv_id", "r.framework", C.test_counts("r.framework", "r.output").alias("c")).select("conv_id", "framework", "c.*")


_SAID = "trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"


@query("model_outputs", f"""SELECT conv_id, turn, if(turn % 2 = 0, 'python', 'java') AS language, CASE turn % 2 WHEN 0 THEN 'x' || conv_id || ' = 1' ELSE 'public class A' || conv_id || ' {{' || chr(10) || '}}' END AS code,
 'Sure:' || chr(10) || 'Said ' || {_SAID} AS explanation, false AS is_empty, false AS is_fallback FROM conversations""")
def model_outputs(spark, sf):
    """Answers with a fenced block, and the conversations' own words behind it."""
    said = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    python, n = F.col("turn") % 2 == 0, F.col("conv_id").cast("string")
    code = F.when(python, F.concat(F.lit("```py\nx"), n, F.lit(" = 1\n```"))).otherwise(F.concat(F.lit("```java\npublic class A"), n, F.lit(" {\n}\n```")))
    told = table(spark, sf, "conversations").select("conv_id", "turn", F.when(python, "python").otherwise("java").alias("language"), F.concat(F.lit("Sure:\n"), code, F.lit("\nSaid "), said).alias("output"))
    return output.parsed_outputs(told).drop("output")


@query("grounding", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'redis,vector database' ELSE '' END AS blocked FROM conversations")
def grounding(spark, sf):
    said = F.when(F.col("turn") % 2 == 0, "Uses Redis and a vector database with Flask").otherwise("Uses Flask")
    held = table(spark, sf, "conversations")
    return held.select("conv_id", "turn", F.array_join(output.ungrounded(said, F.lit("a flask app"), ["redis", "vector database", "flask", "docker"]), ",").alias("blocked"))


@query("write_gate", "SELECT coalesce(reason, 'stored') AS reason, count(*) AS n FROM (SELECT CASE WHEN contains(text, '```') THEN 'markdown' WHEN turn % 3 = 0 THEN 'invalid' WHEN turn % 3 = 1 THEN 'syntax' WHEN conv_id % 2 = 0 THEN 'not_accepted' END AS reason FROM conversations) GROUP BY 1")
def write_gate(spark, sf):
    t = table(spark, sf, "conversations")
    held = t.select(F.col("text").alias("content"), F.lit(False).alias("is_fallback"), (F.col("turn") % 3 != 0).alias("valid"), (F.col("turn") % 3 != 1).alias("syntax_valid"), (F.col("conv_id") % 2 == 1).alias("accepted"), F.lit(None).cast("boolean").alias("tests_passed"))
    return output.write_gate(held).groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


# Streams

@query("stream_index", f"""WITH l AS (SELECT 'd/' || doc_id AS path, {_LINES} AS l FROM (SELECT doc_id, text AS t FROM documents)), w AS (SELECT path, len(l) AS n, unnest(range(0, len(l), 15)) AS s FROM l)
SELECT path, (s + 1)::BIGINT AS start_line, least(s + 20, n)::BIGINT AS end_line FROM w WHERE s = 0 OR s - 15 + 20 < n""")
def stream_index(spark, sf):
    tmp = scratch(spark, "stream")
    files = streams.source(spark, f"{sf}/documents.parquet").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
    made = lambda df: chunk.line_windows(df.select("path", "content"), size=20, overlap=5).select("path", "start_line", "end_line")
    streams.indexing(files, f"{tmp}/c", f"{tmp}/o", made)
    return streams.indexed(spark, f"{tmp}/o")[0].select("path", "start_line", "end_line")


_SEEN = "SELECT count(DISTINCT sha1(concat_ws('|', coalesce(lang, ''), coalesce(text, '')))) AS n FROM documents"


@query("stream_dedup", _SEEN)
def stream_dedup(spark, sf):
    tmp = scratch(spark, "stream")
    held = streams.deduplicated(streams.source(spark, f"{sf}/documents.parquet"), ["lang", "text"])
    return streams.collected(held.select("fp"), f"{tmp}/c", f"{tmp}/o").agg(F.count("*").alias("n"))


@query("stream_history", "SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS events, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY 1")
def stream_history(spark, sf):
    tmp = scratch(spark, "stream")
    return streams.latest(streams.history(streams.source(spark, f"{sf}/events.parquet")), f"{tmp}/c", f"{tmp}/o", "user_id", "n")


@query("stream_ingest", "SELECT least(300, count(*)) AS n FROM documents WHERE lang = 'en'")
def stream_ingest(spark, sf):
    tmp = scratch(spark, "stream")
    n = streams.ingested(streams.source(spark, f"{sf}/documents.parquet"), f"{tmp}/c", f"{tmp}/o", lambda df: df.where("lang = 'en'"), 300)
    return spark.range(1).select(F.lit(n).alias("n"))


_SCANS = """a AS (SELECT 'd/' || doc_id AS path, doc_id AS n, sha256(text) AS sha FROM documents), b AS (SELECT path, n, if(n % 5 = 0, sha256(sha), sha) AS sha FROM a WHERE n % 3 <> 0)"""


@query("stream_removed", f"WITH {_SCANS} SELECT path, 'indexed' AS change, sha AS sha256 FROM a UNION ALL SELECT path, 'indexed', sha FROM b WHERE n % 5 = 0 UNION ALL SELECT path, 'removed', NULL FROM a WHERE n % 3 = 0")
def stream_removed(spark, sf):
    """Three scans of the documents as files, an hour and a half apart in all; the later ones lack a third, and a fifth has changed."""
    tmp = scratch(spark, "stream")
    first = table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("n"), F.sha2("text", 256).alias("sha256"))
    later = first.where("n % 3 <> 0").withColumn("sha256", F.when(F.col("n") % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    for files, minutes in ((first, 0), (later, 60), (later, 80)):
        seen = F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minutes)).alias("seen")
        files.select("path", "sha256", seen).write.mode("append").parquet(f"{tmp}/in")
        scans = spark.readStream.schema("path string, sha256 string, seen timestamp").parquet(f"{tmp}/in")
        keyed.run(keyed.tracked(scans, 30 * 60 * 1000), f"{tmp}/c", f"{tmp}/out")
    return spark.read.parquet(f"{tmp}/out").drop("at")


@query("stream_capped", "SELECT lang, least(40, count(*)) AS n FROM documents GROUP BY 1")
def stream_capped(spark, sf):
    """A cap per language over the batches of a stream."""
    tmp = scratch(spark, "stream")
    held = streams.source(spark, f"{sf}/documents.parquet").select("lang", "doc_id")
    keyed.run(keyed.capped(held, "lang", 40), f"{tmp}/c", f"{tmp}/out")
    return rules.counts(spark.read.parquet(f"{tmp}/out"), "lang")
