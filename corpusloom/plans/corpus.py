"""Queries of corpus preparation: filters, deduplication, splits, merging, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, filters, rank, rules, score, shape
from ..session import OBJECTIVES, RECORDS_SQL, records, table
from .registry import query

LANGUAGES = ["en", "de", "fr"]
RATIOS = {"en": 0.40, "de": 0.10, "fr": 0.20, "es": 0.05}
PERMS, NEAR = 16, 0.8
_R = RECORDS_SQL
_LANGS = "'en', 'de', 'fr'"
_BLOB = "concat_ws(chr(10), coalesce(input, ''), coalesce(output, ''), coalesce(context, ''))"
_RATIO = f"coalesce(length(regexp_replace({_BLOB}, '[\\x00-\\x7F]', '', 'g'))::DOUBLE / nullif(length({_BLOB}), 0), 0)"
_REASON = f"CASE WHEN language IS NULL OR language NOT IN ({_LANGS}) THEN 'language_filtered' WHEN {_RATIO} > 0.06 THEN 'encoding_filtered' WHEN length(input) > 8000 THEN 'too_long' END"


def _reasons(spark, sf):
    return filters.corpus_reasons(records(spark, sf), LANGUAGES, 8000, 0.06)


@query("filter_reasons", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM {_R}) GROUP BY 1")
def filter_reasons(spark, sf):
    return filters.counts_by_reason(_reasons(spark, sf))


@query("filter_kept", f"SELECT id, language FROM {_R} WHERE {_REASON} IS NULL")
def filter_kept(spark, sf):
    return _reasons(spark, sf).where("reason IS NULL").select("id", "language")


@query("non_ascii_ratio", f"SELECT id, round({_RATIO}, 6) AS ratio FROM {_R}")
def non_ascii_ratio(spark, sf):
    return records(spark, sf).select("id", F.round(X.non_ascii_ratio(X.encoding_blob("input", "output", "context")), 6).alias("ratio"))


@query(
    "heuristic_validity",
    """SELECT page_id, kind, length(html) >= 8 AND CASE kind WHEN 'python' THEN contains(html, 'def ') OR contains(html, 'class ')
       WHEN 'java' THEN contains(html, 'class ') OR contains(html, 'public ') WHEN 'javascript' THEN contains(html, 'function') OR contains(html, '=>')
       WHEN 'cpp' THEN contains(html, '{') ELSE contains(html, 'class ') OR contains(html, 'namespace ') END AS valid,
       regexp_matches(lower(html), 'function |class |=>|def |public |private |protected |#include') AS snippet
       FROM (SELECT page_id, html, ['python', 'java', 'javascript', 'cpp', 'csharp'][1 + page_id % 5] AS kind FROM pages)""",
)
def heuristic_validity(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("python", "java", "javascript", "cpp", "csharp")]), (F.col("page_id") % 5 + 1).cast("int"))
    pages = table(spark, sf, "pages").withColumn("kind", kind)
    return pages.select("page_id", "kind", X.heuristic_valid("kind", "html").alias("valid"), X.looks_like_snippet("html").alias("snippet"))


@query("record_validity", "SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN role = 'system' THEN 'missing_id' WHEN trim(text) = '' THEN 'blank_input' WHEN turn % 5 = 0 THEN 'blank_output' END AS reason FROM conversations) GROUP BY 1")
def record_validity(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.when(F.col("role") != "system", F.col("conv_id").cast("string")).alias("id"), F.lit("code_gen").alias("objective"), F.lit("en").alias("language"),
        F.col("text").alias("input"), F.when(F.col("turn") % 5 == 0, " ").otherwise("x").alias("output"), F.lit("").alias("context"), F.create_map(F.lit("source"), F.lit("chat")).alias("metadata"),
    )
    return filters.validity(rows).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


_FIELDS = ["language", "input", "output", "context"]
_FP = "sha1(concat_ws('|', coalesce(language, ''), coalesce(input, ''), coalesce(output, ''), coalesce(context, '')))"


@query("exact_dedup", f"SELECT min(ord) AS ord, {_FP} AS fp FROM {_R} GROUP BY 2")
def exact_dedup(spark, sf):
    return dedup.exact(records(spark, sf), _FIELDS).select("ord", "fp")


@query("dup_groups", f"SELECT {_FP} AS fp, count(*) AS n, min(ord) AS first FROM {_R} GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf):
    return dedup.groups(records(spark, sf), _FIELDS)


@query("objective_dedup", f"SELECT objective, count(DISTINCT sha1(concat_ws('|', objective, language, input, output, context))) AS n FROM {_R} GROUP BY 1")
def objective_dedup(spark, sf):
    return rules.counts(dedup.exact(records(spark, sf), ["objective", *_FIELDS]), "objective")


def _sig_sql(n: int) -> str:
    return f"""w AS (SELECT ord, CASE WHEN len(t) < 5 THEN t || list_transform(range(5 - len(t)), lambda x: '_') ELSE t END AS t
  FROM (SELECT ord, list_filter(regexp_split_to_array(lower(input), '[\\s\\x0B\\x1C-\\x1F]+'), lambda x: x <> '') AS t FROM {_R})),
s AS (SELECT DISTINCT ord, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM w),
m AS (SELECT ord, i, min(md5(i::VARCHAR || s)) AS h FROM s, range({n}) AS r(i) GROUP BY ord, i),
g AS MATERIALIZED (SELECT ord, string_agg(h, '' ORDER BY i) AS sig FROM m GROUP BY ord),
c AS MATERIALIZED (SELECT sig, min(ord) AS ord, count(*) AS n FROM g GROUP BY sig)"""


def _pairs_sql(n: int, t: float) -> str:
    """Pairs of classes that agree in a slice; similar ones differ in fewer slots than there are slices, so they agree in one."""
    count = dedup.band_count(n, t)
    edges = [n * k // count for k in range(count + 1)]
    slices = [f"sig[{32 * a + 1}:{32 * b}]" for a, b in zip(edges, edges[1:])]
    met = " UNION ".join(f"SELECT x.ord AS a, y.ord AS b, x.sig AS sa, y.sig AS sb FROM c x JOIN c y ON x.{s} = y.{s} AND x.ord < y.ord" for s in slices)
    same = f"list_sum(list_transform(range({n}), lambda k: (sa[1 + k * 32:32 + k * 32] = sb[1 + k * 32:32 + k * 32])::INT))"
    return f"p AS MATERIALIZED (SELECT a, b, {same} / {n}::DOUBLE AS sim FROM ({met}) WHERE {same} >= {t} * {n} - 1e-9)"


def _sigs(spark, sf):
    return dedup.signatures(records(spark, sf), "input", PERMS)


@query("minhash_signatures", f"WITH {_sig_sql(PERMS)} SELECT ord, sha1(sig) AS sig FROM g")
def minhash_signatures(spark, sf):
    return _sigs(spark, sf).select("ord", F.sha1(F.array_join("sig", "")).alias("sig"))


@query("minhash_classes", f"WITH {_sig_sql(PERMS)} SELECT ord, n FROM c WHERE n > 1")
def minhash_classes(spark, sf):
    return dedup.classes(_sigs(spark, sf)).where("n > 1").select("ord", "n")


@query("near_dup_pairs", f"WITH {_sig_sql(PERMS)}, {_pairs_sql(PERMS, NEAR)} SELECT a, b, round(sim, 6) AS sim FROM p")
def near_dup_pairs(spark, sf):
    return dedup.pairs(_sigs(spark, sf), PERMS, NEAR).select("a", "b", F.round("sim", 6).alias("sim"))


@query("near_dedup_greedy", f"""WITH RECURSIVE {_sig_sql(PERMS)}, {_pairs_sql(PERMS, NEAR)},
l AS (SELECT b AS ord, list(a) AS near FROM p GROUP BY b), n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM l),
f AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone, NULL::BIGINT AS ord, true AS kept
 UNION ALL SELECT n.i, CASE WHEN len(list_filter(near, lambda a: NOT list_contains(gone, a))) > 0 THEN list_append(gone, n.ord) ELSE gone END, n.ord, len(list_filter(near, lambda a: NOT list_contains(gone, a))) = 0 FROM f JOIN n ON n.i = f.i + 1)
SELECT ord FROM c WHERE ord NOT IN (SELECT ord FROM f WHERE NOT kept)""")
def near_dedup_greedy(spark, sf):
    return dedup.greedy(_sigs(spark, sf), PERMS, NEAR)


def _ranked_sql(group: str, key: str, source: str) -> str:
    over = f"PARTITION BY {group} " if group else ""
    return f"SELECT *, row_number() OVER ({over}ORDER BY sha1('42|' || {key}), {key}) AS r FROM {source}"


_RATIO_ROWS = ", ".join(f"('{k}', {v})" for k, v in RATIOS.items())


@query("rebalance_ratio", f"WITH t AS (SELECT count(*) AS n FROM {_R}), k AS ({_ranked_sql('language', 'id', _R)}) SELECT id, language FROM k JOIN (VALUES {_RATIO_ROWS}) v(l, s) ON language = l, t WHERE r <= floor(n * s)")
def rebalance_ratio(spark, sf):
    return shape.rebalance(records(spark, sf), RATIOS).select("id", "language")


@query("rebalance_min", f"WITH k AS ({_ranked_sql('language', 'id', _R)}), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM {_R} GROUP BY language)) SELECT id, language FROM k, m WHERE r <= n")
def rebalance_min(spark, sf):
    return shape.rebalance_least(records(spark, sf), ["en", "de", "fr", "es"]).select("id", "language")


def _keyed(spark, sf):
    return records(spark, sf).withColumn("repo_key", X.repo_key("repo", "id"))


_KEY = "CASE WHEN trim(coalesce(repo, '')) <> '' AND lower(trim(repo)) <> 'unknown' THEN trim(repo) ELSE 'pseudo-' || substr(sha1(id), 1, 12) END"


@query("repo_keys", f"SELECT {_KEY} AS repo_key, 'pseudo-' || substr(sha1(id), 1, 12) AS fallback, id FROM {_R}")
def repo_keys(spark, sf):
    return _keyed(spark, sf).select("repo_key", X.repo_key(F.lit("Unknown "), "id").alias("fallback"), "id")


def _split_sql(group: str) -> str:
    on, sel, by = (f"USING ({group})", f"{group}, ", f"GROUP BY {group}") if group else ("ON true", "", "")
    both = f"USING ({group}, repo_key)" if group else "USING (repo_key)"
    return f"""WITH x AS (SELECT *, {_KEY} AS repo_key FROM {_R}),
k AS ({_ranked_sql(group, 'repo_key', f'(SELECT DISTINCT {sel}repo_key FROM x)')}),
n AS (SELECT {sel}count(*) AS n, greatest(1, floor(count(*) * 0.85)) AS a0, greatest(1, floor(count(*) * 0.07)) AS b0 FROM k {by}),
z AS (SELECT {sel}n, CASE WHEN a0 + b0 >= n THEN greatest(1, n - 2) ELSE a0 END AS a, CASE WHEN a0 + b0 >= n THEN 1 ELSE b0 END AS b FROM n),
p AS (SELECT {sel}repo_key, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split FROM k JOIN z {on})
SELECT id, split FROM x JOIN p {both}"""


@query("split_by_repo", _split_sql(""))
def split_by_repo(spark, sf):
    return shape.split_groups(_keyed(spark, sf), "repo_key", []).select("id", "split")


@query("split_by_repo_objective", _split_sql("objective"))
def split_by_repo_objective(spark, sf):
    return shape.split_groups(_keyed(spark, sf), "repo_key", ["objective"]).select("id", "split")


_GLOBAL = f"""WITH x AS (SELECT *, {_KEY} AS repo_key FROM {_R}), k AS ({_ranked_sql('', 'repo_key', '(SELECT DISTINCT repo_key FROM x)')}),
n AS (SELECT count(*) AS n FROM k), g AS (SELECT repo_key, CASE WHEN r <= floor(n * 0.85::DOUBLE) THEN 'train' WHEN r <= floor(n * (0.85::DOUBLE + 0.07::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM k, n),
d AS (SELECT x.*, split FROM x JOIN g USING (repo_key))"""


@query("split_global_092", f"{_GLOBAL} SELECT id, split FROM d")
def split_global_092(spark, sf):
    return shape.split_global(_keyed(spark, sf), "repo_key").select("id", "split")


_ROWS = f"""WITH k AS ({_ranked_sql('language', 'id', _R)}), n AS (SELECT language, count(*) AS n FROM {_R} GROUP BY language)
SELECT id, CASE WHEN n <= 2 OR r <= greatest(1, floor(n * 0.85)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.85)) + greatest(1, floor(n * 0.07)) THEN 'val' ELSE 'test' END AS split FROM k JOIN n USING (language)"""


@query("split_rows", _ROWS)
def split_rows(spark, sf):
    return shape.split_rows(records(spark, sf), ["language"]).select("id", "split")


def _split(spark, sf):
    return shape.split_global(_keyed(spark, sf), "repo_key")


@query("split_counts", f"{_GLOBAL} SELECT objective, split, count(*) AS n FROM d GROUP BY ALL")
def split_counts(spark, sf):
    return rules.counts(_split(spark, sf), "objective", "split")


@query("split_leakage", f"{_GLOBAL}, f AS (SELECT {_FP} AS fp, split FROM d) SELECT fp, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM f GROUP BY fp HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf):
    return rules.leaks(_split(spark, sf).withColumn("fp", X.fingerprint(*_FIELDS)), "fp")


@query("split_overlap", f"{_GLOBAL}, f AS (SELECT {_FP} AS fp, split FROM d) SELECT fp FROM f WHERE split = 'train' INTERSECT SELECT fp FROM f WHERE split = 'test'")
def split_overlap(spark, sf):
    held = _split(spark, sf).withColumn("fp", X.fingerprint(*_FIELDS))
    return held.where("split = 'train'").select("fp").intersect(held.where("split = 'test'").select("fp"))


@query("split_collapse_guard", f"{_GLOBAL} SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, true AS ok FROM d")
def split_collapse_guard(spark, sf):
    return shape.collapse_guard(_split(spark, sf))


@query("merge_prefixed", f"{_GLOBAL} SELECT id, split, md5('[TASK: ' || objective || ']' || CASE WHEN input = '' THEN '' ELSE chr(10) || input END) AS input_md5 FROM d")
def merge_prefixed(spark, sf):
    return shape.merged(_split(spark, sf)).select("id", "split", F.md5("input").alias("input_md5"))


@query("merge_checks", "SELECT * FROM (VALUES ('counts', 'train', false), ('counts', 'val', false), ('counts', 'test', false), ('prefix', 'all', true), ('ids', 'present', true), ('leakage', 'ids', true), ('coverage', 'train', true), ('coverage', 'val', true), ('coverage', 'test', true)) t(section, name, ok)")
def merge_checks(spark, sf):
    return rules.merge_checks(shape.merged(_split(spark, sf)), {"train": 165033, "val": 13646, "test": 15624})


@query("preview_sample", f"WITH k AS ({_ranked_sql('', 'ord', _R)}) SELECT ord, CASE WHEN length(input) > 80 THEN substr(input, 1, 80) || '...' ELSE input END AS preview FROM k WHERE r <= 20")
def preview_sample(spark, sf):
    return rules.sample(records(spark, sf), "ord", 20).select("ord", X.preview("input", 80).alias("preview"))


@query("feature_counts", f"SELECT objective, language, count(*) AS n FROM {_R} GROUP BY ALL")
def feature_counts(spark, sf):
    return rules.counts(records(spark, sf), "objective", "language")


@query("language_distribution", f"SELECT language, count(*) AS n, round(count(*) / (SELECT count(*) FROM {_R})::DOUBLE, 6) AS share FROM {_R} GROUP BY 1")
def language_distribution(spark, sf):
    return rules.distribution(records(spark, sf), "language")


@query("retention_report", f"SELECT coalesce(repo, 'ALL') AS repo, count(*)::BIGINT AS raw, count(*) FILTER ({_REASON} IS NULL)::BIGINT AS kept, round(count(*) FILTER ({_REASON} IS NULL)::DOUBLE / count(*), 6) AS retention FROM {_R} GROUP BY ROLLUP (repo)")
def retention_report(spark, sf):
    held = _reasons(spark, sf)
    return rules.retention(held, held.where("reason IS NULL"), "repo")


_BOUNDS = [("objective", o, 100.0, None) for o in OBJECTIVES] + [("language", "en", 0.5, 0.7), ("language", "de", 0.2, 0.35), ("language", "xx", 0.1, None)]
_BOUNDS_SQL = ", ".join(f"('{s}', '{n}', {lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)" for s, n, lo, hi in _BOUNDS)


def _limits(spark, sf):
    held = records(spark, sf)
    measured = rules.counts(held, "objective").select(F.lit("objective").alias("section"), F.col("objective").alias("name"), F.col("n").cast("double").alias("actual"))
    measured = measured.unionByName(rules.distribution(held, "language").select(F.lit("language").alias("section"), F.col("language").alias("name"), F.col("share").alias("actual")))
    return rules.limits(measured, spark.createDataFrame(_BOUNDS, "section string, name string, low double, high double"))


_LIMITS = f"""WITH r AS (SELECT * FROM {_R}), m AS (SELECT 'objective' AS section, objective AS name, count(*)::DOUBLE AS actual FROM r GROUP BY 2 UNION ALL
SELECT 'language', language, round(count(*)::DOUBLE / (SELECT count(*) FROM r), 6) FROM r GROUP BY 2),
l AS (SELECT section, name, actual, low, high, actual IS NOT NULL AND (low IS NULL OR actual >= low) AND (high IS NULL OR actual <= high) AS ok FROM (VALUES {_BOUNDS_SQL}) b(section, name, low, high) LEFT JOIN m USING (section, name))"""


@query("readiness_rules", f"{_LIMITS} SELECT * FROM l")
def readiness_rules(spark, sf):
    return _limits(spark, sf)


@query("readiness_verdict", f"{_LIMITS} SELECT bool_and(ok) AS ready, count(*) FILTER (NOT ok) AS failed, coalesce(string_agg(CASE WHEN NOT ok THEN section || '.' || name END, ',' ORDER BY section || '.' || name), '') AS blockers FROM l")
def readiness_verdict(spark, sf):
    return rules.verdict(_limits(spark, sf))


@query("coverage_matrix", f"SELECT repo, coalesce((SELECT string_agg(l, ',' ORDER BY l) FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) v(l) WHERE l NOT IN (SELECT language FROM {_R} y WHERE y.repo = x.repo)), '') AS missing FROM (SELECT DISTINCT repo FROM {_R}) x")
def coverage_matrix(spark, sf):
    return rules.coverage(records(spark, sf), "repo", "language", ["de", "en", "es", "fr", "it"])


@query("missing_keys", "SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def missing_keys(spark, sf):
    return table(spark, sf, "labels").select("doc_id").exceptAll(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"))


@query("metadata_keys", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def metadata_keys(spark, sf):
    events = table(spark, sf, "events")
    return rules.counts(events.select(F.explode(F.json_object_keys("props")).alias("key")), "key")


@query("metadata_normalize", "SELECT event_id, coalesce((props->>'k')::BIGINT, 0) AS k, '' AS source FROM events")
def metadata_normalize(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("event_id").alias("ord"), F.col("props").alias("metadata"))
    filled = shape.metadata_filled(events, {"k": "long", "source": "string"})
    return filled.select("event_id", "metadata.k", "metadata.source")


@query("metadata_types", "SELECT 'k' AS key, 'long' AS kind")
def metadata_types(spark, sf):
    return shape.metadata_types(table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.col("props").alias("metadata")))


@query("null_nan_scan", "SELECT event_type, count(*) FILTER (value IS NULL OR isnan(value) OR props IS NULL OR ts IS NULL) AS broken, count(*) AS n FROM events GROUP BY 1")
def null_nan_scan(spark, sf):
    events = table(spark, sf, "events")
    return events.withColumn("bad", filters.broken(events.schema, infinite=True)).groupBy("event_type").agg(F.count_if("bad").alias("broken"), F.count("*").alias("n"))


@query("per_group_cap", f"SELECT repo, count(*) FILTER (r <= 30) AS kept, count(*) FILTER (r > 30) AS over_cap FROM (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ord) AS r FROM {_R}) GROUP BY 1")
def per_group_cap(spark, sf):
    held = shape.capped(records(spark, sf), ["repo"], "ord", 30)
    return held.groupBy("repo").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason") == "over_cap").alias("over_cap"))


@query("language_aliases", "SELECT d.source AS repo, CASE d.lang WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'cpp' ELSE d.lang END AS language, count(*) AS n FROM documents d GROUP BY ALL")
def language_aliases(spark, sf):
    raw = F.when(F.col("lang") == "fr", " JS ").when(F.col("lang") == "de", "C++").otherwise(F.col("lang"))
    return rules.counts(table(spark, sf, "documents").select(F.col("source").alias("repo"), X.alias_language(raw).alias("language")), "repo", "language")


@query("first_present", "SELECT c_custkey, coalesce(c_mktsegment, c_name, '') AS value FROM customer")
def first_present(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.first_present(["segment", "c_mktsegment", "c_name"], c.columns).alias("value"))


@query("prompt_template", "SELECT conv_id, turn, md5('### Task' || chr(10) || role || chr(10) || chr(10) || '### Input' || chr(10) || text || chr(10) || chr(10) || '### Response' || chr(10) || 'ok') AS prompt_md5 FROM conversations")
def prompt_template(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.prompt("role", "text", F.lit("ok"))).alias("prompt_md5"))


@query("normalized_text", "SELECT conv_id, turn, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5 FROM conversations")
def normalized_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.normalized("text")).alias("text_md5"))


# Scores: a turn against the next one of its conversation

_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]')"
_BLEU = f"""WITH e AS (SELECT a.conv_id * 1000 + a.turn AS k, {_TOK.format('a.text')} AS c, {_TOK.format('b.text')} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
x AS (SELECT k, n, array_to_string(c[i:i + n - 1], chr(1)) AS g, 1 AS a, 0 AS b FROM (SELECT k, c, n, unnest(range(1, len(c) - n + 2)) AS i FROM e, range(1, 5) t(n))
 UNION ALL SELECT k, n, array_to_string(r[i:i + n - 1], chr(1)), 0, 1 FROM (SELECT k, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM e, range(1, 5) t(n))),
y AS (SELECT k, n, g, sum(a) AS a, sum(b) AS b FROM x GROUP BY ALL), z AS (SELECT k, n, sum(least(a, b)) AS o, sum(a) AS t FROM y GROUP BY ALL),
s AS (SELECT k, sum(ln((o + 1.0) / (t + 1.0))) AS s, count(*) AS m FROM z WHERE t > 0 GROUP BY k)
SELECT e.k, round(CASE WHEN m = 4 AND len(r) > 0 THEN exp(s / 4) * CASE WHEN len(c) > len(r) THEN 1.0 ELSE exp(1.0 - len(r)::DOUBLE / len(c)) END ELSE 0 END, 6) AS bleu FROM e LEFT JOIN s USING (k)"""


def _answers(spark, sf):
    t = table(spark, sf, "conversations")
    a, b = t.select("conv_id", "turn", F.col("text").alias("c")), t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "c", "r")


@query("bleu_sentence", _BLEU)
def bleu_sentence(spark, sf):
    return score.bleu(_answers(spark, sf), "k", "c", "r").select("k", F.round("bleu", 6).alias("bleu"))


_ROUGE = f"""e AS (SELECT a.conv_id * 1000 + a.turn AS k, a.text AS ct, b.text AS rt, {_TOK.format('a.text')} AS c, {_TOK.format('b.text')} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
t AS (SELECT k, 0 AS i, list_transform(range(len(r) + 1), lambda x: 0) AS row FROM e
 UNION ALL SELECT k, i + 1, list_transform(range(1, len(m) + 1), lambda j: list_max(m[1:j])) FROM (SELECT t.k, t.i, [0] || list_transform(range(1, len(r) + 1), lambda j: CASE WHEN c[t.i + 1] = r[j] THEN row[j] + 1 ELSE row[j + 1] END) AS m FROM t JOIN e USING (k) WHERE t.i < len(c))),
z AS (SELECT e.k, CASE WHEN row[-1] > 0 THEN 2.0 * row[-1] / (len(c) + len(r)) ELSE 0 END::DOUBLE AS rouge FROM e JOIN t ON t.k = e.k AND t.i = len(c))"""


@query("rouge_l", f"WITH RECURSIVE {_ROUGE} SELECT k, round(rouge, 6) AS rouge FROM z")
def rouge_l(spark, sf):
    return _answers(spark, sf).select("k", F.round(score.rouge_l("c", "r"), 6).alias("rouge"))


@query("eval_by_objective", f"""WITH RECURSIVE b AS ({_BLEU.replace(", 6) AS bleu", ", 15) AS bleu")}), {_ROUGE},
s AS (SELECT [{", ".join(f"'{o}'" for o in OBJECTIVES)}][1 + k % 7] AS objective, trim(regexp_replace(ct, '\\s+', ' ', 'g')) = trim(regexp_replace(rt, '\\s+', ' ', 'g')) AS exact, bleu, rouge FROM e JOIN b USING (k) JOIN z USING (k))
SELECT coalesce(objective, 'ALL') AS objective, count(*) AS n, count(*) FILTER (exact) AS exact, round(avg(bleu), 6) AS bleu, round(avg(rouge), 6) AS rouge FROM s GROUP BY GROUPING SETS ((objective), ())""")
def eval_by_objective(spark, sf):
    pairs = _answers(spark, sf)
    objective = F.element_at(F.array(*[F.lit(o) for o in OBJECTIVES]), (F.pmod("k", F.lit(7)) + 1).cast("int"))
    scored = pairs.join(score.bleu(pairs, "k", "c", "r"), "k").select(objective.alias("objective"), (X.normalized("c") == X.normalized("r")).alias("exact"), "bleu", score.rouge_l("c", "r").alias("rouge"))
    return score.by_objective(scored).withColumns({"bleu": F.round("bleu", 6), "rouge": F.round("rouge", 6)})


@query("union_all_splits", f"{_GLOBAL} SELECT split, language, count(*) AS n FROM d WHERE split <> 'val' GROUP BY ALL")
def union_all_splits(spark, sf):
    held = _split(spark, sf)
    return rules.counts(held.where("split = 'train'").unionByName(held.where("split = 'test'")), "split", "language")


@query("repo_split_lookup", "SELECT o.o_orderkey % 5 AS bucket, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment <> 'BUILDING' GROUP BY 1")
def repo_split_lookup(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy((F.col("o_orderkey") % 5).alias("bucket")).agg(F.count("*").alias("n"))


@query("fact_report", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def fact_report(spark, sf):
    held = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02'")
    return held.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("top_sources", f"SELECT repo, n FROM (SELECT repo, count(*) AS n FROM {_R} GROUP BY 1) ORDER BY n DESC, repo LIMIT 5")
def top_sources(spark, sf):
    return rules.counts(records(spark, sf), "repo").orderBy(F.desc("n"), "repo").limit(5)


@query("hash_rank", f"WITH k AS ({_ranked_sql('repo', 'id', _R)}) SELECT id, r AS rank FROM k")
def hash_rank(spark, sf):
    return rank.hash_rank(records(spark, sf), ["repo"], "id").select("id", "rank")
