"""Faults that larger tables showed, each on a few rows."""

import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.functions import minhash
from corpusloom.operators import cells, dedup, graph, index, inverted, retrieve, summary, vector
from corpusloom.plans import code, retrieval

HIDDEN = [
    ("a.js", "javascript", "// a function zip and class Q\nfunction g1(a) { return 'function h'; }"),
    ("b.rs", "rust", "/* fn ingst */\nfn draw() {}\nstruct S { x: i32 }\n"),
    ("docs/README.md", "markdown", "# T\nthe def be of a class room\n"),
]


def test_comments_literals_and_prose_define_nothing():
    got = {path: C.structure(code, language) for path, language, code in HIDDEN}
    assert [got[p]["functions"] for p, _, _ in HIDDEN] == [["g1"], ["draw"], []]
    assert [[c["name"] for c in got[p]["classes"]] for p, _, _ in HIDDEN] == [[], ["S"], []]


def test_graph_has_no_functions_of_comments(spark):
    files = spark.createDataFrame(HIDDEN, "path string, language string, content string")
    got = {tuple(r) for r in graph.build(files).where("relation = 'FUNCTION_BELONGS_TO_FILE'").select("src", "dst").collect()}
    assert got == {("g1", "a.js"), ("draw", "b.rs")}


def test_relations_have_no_symbols_of_comments(spark):
    files = spark.createDataFrame(HIDDEN, "path string, language string, content string")
    got = {r["path"]: (r["functions"], r["related_symbols"]) for r in graph.relations(files).collect()}
    assert got == {"a.js": (["g1"], ["g1"]), "b.rs": (["draw"], ["S", "draw"]), "docs/README.md": ([], [])}


def test_relations_leave_out_no_partner(spark):
    """More calls, imports, importers, tests, symbols, parents and children than any list once had."""
    rows = [(f"app/m{i}.py", "python", f"def f{i}():\n    pass\n") for i in range(105)] + [(f"web/j{i}.js", "javascript", f"function g{i}() {{\n}}\n") for i in range(60)]
    rows += [("app/hub.py", "python", "def hub():\n" + "".join(f"    f{i}()\n" for i in range(105))), ("web/hub.js", "javascript", "".join(f"g{i}();\n" for i in range(60)))]
    rows += [("app/wide.py", "python", "".join(f"import app.m{i}\n" for i in range(105)))] + [(f"tests/test_t{i}.py", "python", "import app.m0\n") for i in range(25)]
    kin, own = [f"K{i}" for i in range(1100)], [f"h{i}" for i in range(40)]
    rows += [("app/base.py", "python", "class Base:\n    pass\n"), ("lib/base.py", "python", "class Base:\n    pass\n")]
    rows += [("app/kin.py", "python", "".join(f"class {k}(Base):\n    pass\n" for k in kin) + "".join(f"def {h}():\n    pass\n" for h in own)), ("app/heir.py", "python", f"class Heir({', '.join(kin)}):\n    pass\n")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    near = {r["path"]: r for r in graph.relations(files).collect()}
    python, script = sorted(f"app/m{i}.py" for i in range(105)), sorted(f"web/j{i}.js" for i in range(60))
    assert [(near[p]["call_count"], near[p]["related_files"]) for p in ("app/hub.py", "web/hub.js")] == [(105, python), (60, script)]
    assert (near["app/wide.py"]["imports"], near["app/wide.py"]["related_files"], near["app/wide.py"]["dependency_count"]) == (python, python, 105)
    tests = sorted(f"tests/test_t{i}.py" for i in range(25))
    assert (near["app/m0.py"]["imported_by"], near["app/m0.py"]["related_tests"], near["app/m0.py"]["dependency_count"]) == (["app/wide.py", *tests], tests, 26)
    assert near["app/base.py"]["child_classes"] == near["lib/base.py"]["child_classes"] == near["app/heir.py"]["parent_classes"] == sorted(kin)
    assert (near["app/kin.py"]["functions"], near["app/kin.py"]["related_symbols"]) == (own, [*kin, *own, "Base"])
    calls = graph.build(files).where("relation = 'FUNCTION_CALLS_FUNCTION'").groupBy("src").count().collect()
    assert {tuple(r) for r in calls} == {("app/hub.py", 105), ("web/hub.js", 60)}


def test_short_views_of_relations_and_calls(spark):
    """With caps lists end there, counts don't; called names end where a caller asks for it."""
    rows = [(f"m{i:02}.py", "python", f"def f{i}():\n    pass\n") for i in range(20)] + [("hub.py", "python", "".join(f"f{i}()\n" for i in range(20)))]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    hub = graph.relations(files, graph.CAPS).where("path = 'hub.py'").first()
    assert (hub["call_count"], hub["related_files"]) == (20, [f"m{i:02}.py" for i in range(15)])
    got = files.where("path = 'hub.py'").select(C.called_functions("content", "language", 3), C.called_functions("content", "language")).first()
    assert list(got) == [["f0", "f1", "f2"], [f"f{i}" for i in range(20)]]


def test_lines_of_a_readme_keep_their_digits(spark):
    df = spark.createDataFrame([("# Head\n token=d3d1 \n22.8.1.2",)], "t string")
    assert df.select(summary.readme_summary("t")).first()[0] == "Head token=d3d1 22.8.1.2"
    df = spark.createDataFrame([("import a0\n  import b1\n",)], "t string")
    assert df.select(C.import_lines("t", F.lit("python"))).first()[0] == ["import a0", "import b1"]


def test_words_of_names_by_pattern(spark):
    df = spark.createDataFrame([(["SSver"],)], "s array<string>")
    assert df.select(retrieve.fragments(F.col("s"))).first()[0] == ["s", "s_sver", "sver"]
    assert df.select(retrieve.fragments(F.col("s"), r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")).first()[0] == ["ss", "ss_ver", "ver"]


def _folder(spark, n):
    return spark.range(n, numPartitions=5).select(F.concat(F.lit("big/"), F.col("id").cast("string")).alias("path"))


def test_a_folder_is_one_row_that_lists_all_files(spark):
    files = _folder(spark, 2500).unionByName(spark.createDataFrame([("one.py",), ("small/b",), ("small/a",)], "path string"))
    got = {r["relative_path"]: r["content"] for r in index.folder_rows(files, "/w").collect()}
    assert got["big"] == "Folder: big\nContains:\n- " + "\n- ".join(sorted(f"big/{i}" for i in range(2500)))
    assert got["small"] == "Folder: small\nContains:\n- small/a\n- small/b" and set(got) == {"big", "small", "root"}


def test_an_index_has_a_point_a_folder(spark):
    files = _folder(spark, 1500).select("path", F.lit("text").alias("language"), F.col("path").alias("content"), F.sha2("path", 256).alias("sha256"))
    none = files.limit(0)
    edges = files.select(F.col("path").alias("src"), F.col("path").alias("dst"), F.lit("FILE_IMPORTS_FILE").alias("relation")).limit(0)
    points = index.renewed(files, none.select("path", "sha256"), index.payloads(none, "/w"), "/w", edges=edges)[0]
    got = points.where("chunk_type = 'folder_summary'").select("relative_path", F.sha2("content", 256)).collect()
    assert [tuple(r) for r in got] == [("big", hashlib.sha256(("Folder: big\nContains:\n- " + "\n- ".join(sorted(f"big/{i}" for i in range(1500)))).encode()).hexdigest())]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_made_files_are_worked_out_once(spark, sf):
    assert _plan(code._files(spark, sf)).count("regexp_replace") == 1


def test_signals_of_files_need_no_parse(spark, sf, monkeypatch):
    monkeypatch.setattr(graph, "build", lambda files: 1 / 0)
    assert code.file_signals(spark, sf).count() == 3 * spark.read.parquet(f"{sf}/documents.parquet").count()


def test_facts_of_a_project_read_cut_signals(spark, sf):
    assert _plan(code.project_facts(spark, sf)).count("regexp") == 0


def test_batches_meet_as_blocks_with_the_scores_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300, None), (301, [1.0, None, 2.0, 0.5]), (302, [1.0, 2.0]), (303, [0.0] * 4), (304, [float("nan")] * 4)]
    points = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = points.where("id % 7 = 0 or id >= 300").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    want = points.crossJoin(asked).select("query", "id", vector.cosine("vector", "qv").alias("score"))
    want = want.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("long")).where("rank <= 5")
    monkeypatch.setattr(vector, "POINTS", 40)
    monkeypatch.setattr(vector, "QUERIES", 20)
    got = vector.search_batch(points, asked, 5)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "FlatMapCoGroupsInPandas" in _plan(got)


def test_cells_are_scored_by_blocks(spark, tmp_path):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(200)], "id long, vector array<double>")
    asked = points.where("id % 40 = 0").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    cells.build(points, str(tmp_path / "c"), 4)
    got = cells.search(spark, str(tmp_path / "c"), asked, 3)
    assert "FlatMapCoGroupsInPandas" in _plan(got)
    assert sorted(map(repr, got.select("query", "id", "score", "rank").collect())) == sorted(map(repr, vector.search_batch(points, asked, 3).collect()))


def _plain_slots(words, n):
    runs = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
    return [min(hashlib.md5(f"{k}{r}".encode()).hexdigest() for r in runs) for k in range(n)]


def test_slots_are_the_least_md5s_whatever_the_sizes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RUNS", 50)  # a text's runs are looked at in parts
    monkeypatch.setattr(minhash, "BYTES", 3000)
    monkeypatch.setattr(minhash, "MESSAGES", 20)
    edges = [["a", "b", "c", "d", "x" * k] for k in (45, 46, 47, 48, 109, 110, 111, 112, 237, 238, 500)]
    texts = [*edges, ["w"] * 400, [f"\u044f{i % 90}\U0001f600" for i in range(300)], ["a\0", "a", "a", "a", "a", "a\0\0"], ["_"] * 5, ["a", "b", "_", "_", "_"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts[:-2])] + [(len(texts) - 2, " "), (len(texts) - 1, "A\tb"), (len(texts), None)]
    sigs = dedup.signatures(spark.createDataFrame(rows, "ord long, input string"), "input", 101)
    assert "ArrowEvalPython" in _plan(sigs) and "md5" not in _plan(sigs)
    got = dict(sigs.collect())
    assert got.pop(len(texts)) == [None] * 101
    assert got == {i: _plain_slots(t, 101) for i, t in enumerate(texts)}
    import pyarrow as pa

    held = pa.array([" ".join(t).encode() for t in texts], "binary")
    assert minhash.least_digests(held[3:], 101, 5).to_pylist() == [got[i] for i in range(3, len(texts))]


def test_lists_of_blocks_have_every_gram_once_a_key(spark, tmp_path, monkeypatch):
    texts = ["", "ab", "aba", "abababa", None, "\u00e9\U0001f642x\u65e5", "a\0b\0", "abc " * 50, *[chr(200 + i) + chr(900 + i) + "xyz" for i in range(40)]]
    points = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, content string").repartition(2)
    monkeypatch.setattr(inverted, "BLOCK", 30)
    path = str(tmp_path / "i")
    inverted.build(points, path, parts=2)
    blobs = {f"k{i}": ((t or "").lower() + " " * 8) for i, t in enumerate(texts)}
    want = sorted({(b[i : i + 3], k) for k, b in blobs.items() for i in range(len(b) - 2)})
    lists = inverted._lists(spark, path)
    assert sorted(map(tuple, lists.select("gram", F.explode("keys")).collect())) == want
    assert lists.where("n <> size(keys)").count() == 0
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").collect()}
    assert counts == {g: sum(g == h for h, _ in want) for g in {g for g, _ in want}}
    held = spark.createDataFrame([("k", bytearray(b"ab\xff\xc3caf\xc3\xa9x"))], "key string, blob binary")
    assert sorted(r["gram"] for r in inverted._listed(held).collect()) == ["af\u00e9", "caf", "f\u00e9x"]


ODD_CODE = [
    "public static int  add (a", "static foo(", "(  <> bar (", "<> bar(", "\u00e9foo bar(x) a  b (c", "x 9y (", "a(b c(d e (", "export const f = async (", "let g  =  (", "def h (x) class\tK", "fn  z(", "function q (",
    "one two three", "a b\n\n c d (", "", None, "public\nclass Q", "letter x = (", "undef f(", "List<int> xs (", "w " * 300 + "(",
]


def test_symbols_by_patterns_that_take_no_step_back(spark):
    df = spark.createDataFrame([(t,) for t in ODD_CODE], "t string")
    name = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in C.SYMBOL_NAME])
    count = sum((F.regexp_count("t", F.lit(p)) for p in C.SYMBOL_COUNT), F.lit(0)).cast("long")
    rows = df.select("t", name.alias("n"), C.symbol_name("t").alias("m"), count.alias("c"), C.symbol_count("t").alias("d")).collect()
    assert [(r["t"], r["m"], r["d"]) for r in rows] == [(r["t"], r["n"], r["c"]) for r in rows]
    assert any(r["n"] for r in rows) and any(r["c"] for r in rows)


def test_a_chunks_language_is_found_once(spark):
    files = spark.createDataFrame([("a/x.txt", "text", "one\ntwo", "s")], "path string, language string, content string, sha256 string")
    assert _plan(index.payloads(files, "/w")).count("namespace ") <= 5


def test_words_of_hashed_embeddings_are_hashed_once(spark, sf):
    plan = _plan(retrieval.hash_embedding_topk(spark, sf))
    assert plan.count("sha2(") == 2  # of all texts, and of the one that is asked for
    assert _plan(retrieval.hash_embedding(spark, sf)).count("sha2(") == 1


def test_hashed_embeddings_by_places_are_those_of_rows(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, None), (None, "x y"), (4, "w " * 999 + "z")], "k long, t string")
    got = {(r["k"], r["i"]): r["v"] for r in vector.sparse_embedding(df, "k", "t", 8).collect()}
    want = {(r["k"], i): v for r in df.where("k is not null").select("k", vector.hash_embedding("t", 8).alias("v")).collect() for i, v in enumerate(r["v"]) if v}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
