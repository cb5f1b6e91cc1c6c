"""Queries of sources, training examples and short texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters, retrieve, summary, training, vector
from ..session import table
from ..sources import readers
from .registry import query


@query("candidate_ids", "SELECT n_regionkey::VARCHAR AS name, min_by(n_name, n_nationkey) FILTER (n_nationkey % 3 <> 0) AS id, coalesce(string_agg('no ' || n_name, '; ' ORDER BY n_nationkey) FILTER (n_nationkey % 3 = 0), '') AS errors FROM nation GROUP BY 1")
def candidate_ids(spark, sf):
    n = table(spark, sf, "nation")
    tried = n.select(F.col("n_regionkey").cast("string").alias("name"), F.col("n_name").alias("id"), F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") % 3 != 0).alias("ok"), F.concat(F.lit("no "), "n_name").alias("error"))
    return readers.resolved_ids(tried)


@query("scroll_page", "SELECT vec_id AS id FROM embeddings WHERE label::VARCHAR = '4' AND vec_id > 20 ORDER BY vec_id LIMIT 10")
def scroll_page(spark, sf):
    return readers.scroll(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), {"label": "4"}, 10, 20).select("id")


@query("source_probe", "SELECT (SELECT count(*) FROM documents) AS n, 'doc_id,text,lang,source,n_chars' AS columns")
def source_probe(spark, sf):
    n, columns, _ = readers.probe(table(spark, sf, "documents"))
    return spark.createDataFrame([(n, ",".join(columns))], "n long, columns string")


@query("source_statuses", "SELECT r_name AS name, CASE WHEN n IS NULL THEN 'missing' WHEN n < 5 THEN 'small' ELSE 'ok' END AS status, coalesce(n, 0) AS n FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey % 4 <> 0 AND n_regionkey <> 2 GROUP BY 1) ON r_regionkey = n_regionkey")
def source_statuses(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation").where("n_nationkey % 4 <> 0 and n_regionkey <> 2")
    found = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("n"))
    return readers.statuses(r.select(F.col("r_name").alias("name")), found, 5)


@query("raw_rows", "SELECT source AS repo, CASE lang WHEN 'fr' THEN 'javascript' ELSE lang END AS language, count(*) AS n FROM documents GROUP BY ALL")
def raw_rows(spark, sf):
    raw = table(spark, sf, "documents").select(F.when(F.col("lang") == "fr", "js").otherwise(F.col("lang")).alias("lang"), F.col("text").alias("content"), F.col("source").alias("repository"))
    return readers.normalized_rows(raw).groupBy("repo", "language").agg(F.count("*").alias("n"))


@query("train_labels", "SELECT conv_id, turn, least(octet_length(encode(role)), 64)::BIGINT AS masked, (least(octet_length(encode(role)) + octet_length(encode(text)), 64) - least(octet_length(encode(role)), 64))::BIGINT AS learned FROM conversations")
def train_labels(spark, sf):
    held = training.labelled(table(spark, sf, "conversations"), "role", "text", 64)
    learned = F.size(F.filter("labels", lambda x: x != training.MASKED))
    return held.select("conv_id", "turn", (F.size(F.filter("attention_mask", lambda x: x == 1)) - learned).cast("long").alias("masked"), learned.cast("long").alias("learned"))


@query("progress_state", "SELECT n_name AS phase, CASE WHEN n_nationkey % 2 = 0 THEN 'done' ELSE 'pending' END AS status FROM nation")
def progress_state(spark, sf):
    n = table(spark, sf, "nation")
    state = n.select(F.col("n_name").alias("phase"), F.lit("pending").alias("status"))
    return vector.upsert(state, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("phase"), F.lit("done").alias("status")), "phase")


@query("file_summaries", "SELECT 'p' || n_nationkey AS path, 'File: p' || n_nationkey || chr(10) || 'Language: python' || chr(10) || CASE WHEN n_regionkey > 0 THEN 'Symbols: ' || n_name || chr(10) ELSE '' END || 'Importance: 0.5' AS summary FROM nation")
def file_summaries(spark, sf):
    n = table(spark, sf, "nation")
    held = n.select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("path"), F.lit("python").alias("language"), F.when(F.col("n_regionkey") > 0, F.array("n_name")).alias("symbols"), F.array().cast("array<string>").alias("imports"), F.lit(0.5).alias("importance_score"))
    return summary.file_summary(held)


@query("readme_summaries", """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split('# Head' || chr(10) || text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, md5(substr(array_to_string(['Head'] || l[2:6], ' '), 1, 1200)) AS summary_md5 FROM d""")
def readme_summaries(spark, sf):
    text = F.concat(F.lit("# Head\n"), "text")
    return table(spark, sf, "documents").select("doc_id", F.md5(summary.readme_summary(text)).alias("summary_md5"))


@query("executive_summaries", "SELECT conv_id, turn, 'Turn ' || turn || ' went well' AS summary FROM conversations")
def executive_summaries(spark, sf):
    body = F.concat(F.lit("# R\n## 1. Executive Summary\n- Turn "), F.col("turn").cast("string"), F.lit("\n* went well\n\n## 2. More\nx"))
    return table(spark, sf, "conversations").select("conv_id", "turn", summary.executive_summary(body).alias("summary"))


@query("fact_blocks", "SELECT r_name, 'Nations:' || chr(10) || coalesce('- ' || string_agg(n_name, chr(10) || '- ' ORDER BY n_name), '(none detected)') AS block FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_regionkey <> 1 GROUP BY 1")
def fact_blocks(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation").where("n_regionkey <> 1")
    held = r.join(n, r.r_regionkey == n.n_regionkey, "left").groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return held.select("r_name", summary.fact_block("Nations", "names").alias("block"))


@query("stitched_texts", "SELECT conv_id, turn, md5(substr(text, 21)) AS rest_md5 FROM conversations WHERE length(text) > 40")
def stitched_texts(spark, sf):
    held = table(spark, sf, "conversations").where(F.length("text") > 40)
    before = F.concat(F.lit("\x01"), F.substring("text", 1, 20))
    return held.select("conv_id", "turn", F.md5(X.without_overlap(before, "text")).alias("rest_md5"))


@query("code_spans", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'x = ' || turn || chr(10) ELSE 'def f(): ' || turn END AS span FROM conversations")
def code_spans(spark, sf):
    t = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("see\n```js\nlet\n```\n```py\nx = "), t, F.lit("\n```"))).otherwise(F.concat(F.lit("so def f(): "), t))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.code_span(text, "python").alias("span"))


@query("syntax_filter", "SELECT conv_id, turn, turn % 3 <> 1 AS kept FROM conversations")
def syntax_filter(spark, sf):
    t = F.col("turn") % 3
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(t == 2, "bug_fix").otherwise("code_gen").alias("objective"), F.lit("python").alias("language"), F.when(t == 0, "def f():\n    return 1").otherwise("def f(:").alias("input"), F.lit("").alias("output"), F.lit("").alias("context"))
    return filters.syntax_kept(rows).select("conv_id", "turn", "kept")


@query("human_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f B', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024) ELSE printf('%.2f MB', n / 1048576) END AS size FROM (SELECT doc_id, n_chars::DOUBLE AS n FROM documents)")
def human_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.human_bytes("n_chars").alias("size"))


@query("entity_matches", "SELECT doc_id, source = 'src3' AS folder, doc_id % 4 = 0 AS file FROM documents")
def entity_matches(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/m"), (F.col("doc_id") % 4).cast("string"), F.lit(".py"))
    match = lambda kind, name: retrieve.entity_matches(path, F.lit(""), F.lit(""), F.col("source"), F.lit(kind), F.lit(name))
    return d.select("doc_id", match("folder", "SRC3/").alias("folder"), match("file", "m0.py").alias("file"))
