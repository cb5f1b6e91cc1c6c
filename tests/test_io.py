import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunk, filters, graph, index, shape, store, vector
from corpusloom.session import checkpointed, plain_scan
from corpusloom.sources import readers, trees, writers
from corpusloom.streaming import streams


def planted(top):
    for name, data in {
        "src/a.rs": b"fn main() {}", "README.md": b"# T\r\nx\xff", "compose.yml": b"a: 1", "node_modules/x.ts": b"x", "pkg/build/y.py": b"y", "big.json": b" " * 1_000_001, "most.json": b" " * 1_000_000, "p.png": b"x", "k.pem": b"K", ".env": b"K=1",
        "bin.py": b"a\0b", "odd.py": b"\x01\x02\x03ab", "__init__.py": b"", "_util.py": b"u = 1", ".github/ci.yml": b"on: push", "_priv/m.py": b"m = 2", ".env.example": b"", "e/.env.x": b"", "empty": b"",
    }.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    (top / "lost.py").symlink_to(top / "nowhere")
    (top / "src" / "again").symlink_to(top)
    with open(top / "huge.py", "wb") as f:
        f.truncate(3 << 30)


TREE = {
    "src/a.rs": (None, "rust"), "README.md": (None, "markdown"), "compose.yml": (None, "yaml"), "most.json": (None, "json"), "big.json": ("too_large", None), "p.png": ("unsupported_type", None), "k.pem": ("secret", None), ".env": ("secret", None),
    "bin.py": ("binary", None), "odd.py": ("binary", None), "__init__.py": (None, "python"), "_util.py": (None, "python"), ".github/ci.yml": (None, "yaml"), "_priv/m.py": (None, "python"), ".env.example": ("unsupported_type", None), "e/.env.x": ("secret", None),
    "empty": ("unsupported_type", None), "lost.py": ("stat_failed", None), "huge.py": ("too_large", None),
}


def test_tree(spark, tmp_path):
    planted(tmp_path)
    root = str(tmp_path)
    rows = {r["path"]: r for r in readers.tree(spark, root).collect()}
    assert {p: (r["skip"], r["language"]) for p, r in rows.items()} == TREE
    assert rows["README.md"]["content"] == "# T\nx" and rows["huge.py"]["length"] == 3 << 30 and rows["lost.py"]["length"] is None
    assert rows["_util.py"]["sha256"] == hashlib.sha256(b"u = 1").hexdigest() and rows["bin.py"]["sha256"] is None
    told = {(r["what"], r["name"]): r["n"] for r in trees.statistics(trees.scan(spark, root, contents=False)).collect()}
    assert told == {
        ("folder", "node_modules"): 1, ("folder", "pkg/build"): 1, ("skipped", "secret"): 3, ("skipped", "unsupported_type"): 3, ("skipped", "stat_failed"): 1, ("skipped", "too_large"): 2, ("skipped", "binary"): 2,
        ("language", "rust"): 1, ("language", "markdown"): 1, ("language", "yaml"): 2, ("language", "json"): 1, ("language", "python"): 3,
    }
    first = sorted(p for p, (skip, _) in TREE.items() if skip is None)[:3]
    got = readers.tree(spark, root, 3).collect()
    assert sorted(r["path"] for r in got if r["skip"] is None) == first and len(got) == sum(p <= first[-1] for p in TREE)
    assert readers.tree(spark, root, 100).count() == len(TREE)
    assert tuple(readers.folder_size(spark, str(tmp_path / "_priv")).first()) == (1, 5)


def test_tree_opens_only_what_it_must(spark, tmp_path):
    planted(tmp_path)
    reader = trees.TreeReader({"path": str(tmp_path), "split_bytes": "1"})
    opened = [p for part in reader.partitions() for p, _ in part.opened]
    assert sorted(opened) == sorted(p for p, (skip, _) in TREE.items() if skip in (None, "binary")) and len(reader.partitions()) == len(opened) + 1
    reader = trees.TreeReader({"path": str(tmp_path), "prefix": "_p", "kept": "true"})
    assert reader._entered("_priv") and not reader._entered("src") and [p for part in reader.partitions() for p, _ in part.opened] == ["_priv/m.py"]
    found = trees.scan(spark, str(tmp_path))
    both = found.where("skip IS NULL").select("path").union(found.where("skip IS NOT NULL").select("path"))
    assert both.count() == found.count() == len(TREE) + 2 and trees.scan(spark, str(tmp_path), kept=True).count() == sum(skip is None for skip, _ in TREE.values())
    assert [r["path"] for r in trees.scan(spark, str(tmp_path), prefix="src/").collect()] == ["src/a.rs"]


def test_tree_is_written(spark, tmp_path):
    df = spark.createDataFrame([("a/__init__.py", "é"), ("a/.b/c.py", None), (".d.py", "x\ny")], "path string, content string").repartition(3)
    trees.write(df, str(tmp_path / "t"))
    assert {r["path"]: r["content"] for r in readers.tree(spark, str(tmp_path / "t")).collect()} == {"a/__init__.py": "é", "a/.b/c.py": "", ".d.py": "x\ny"}
    with pytest.raises(Exception):
        trees.write(spark.createDataFrame([("../x.py", "")], "path string, content string"), str(tmp_path / "t"))


def test_json_lines(spark, tmp_path):
    good = {"id": "1", "input": "é", "metadata": {"a": "b"}}
    (tmp_path / "x").mkdir()
    p = tmp_path / "x" / "f.jsonl"
    p.write_text(json.dumps(good) + "\n\nnot json\n[1]\n" + json.dumps({"id": "2"}) + "\n")
    rows, bad = readers.jsonl_tolerant(spark, str(p))
    assert [r["id"] for r in rows.collect()] == ["1", "2"] and bad.count() == 2
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p)).collect()
    assert {r["objective"] for r in readers.objectives(spark, str(tmp_path)).collect()} == {"x"}
    assert tuple(readers.line_counts(spark, str(p)).first()) == (5, 4)
    assert writers.jsonl(rows, str(tmp_path / "out")) == 2
    assert readers.jsonl(spark, str(tmp_path / "out")).count() == 2


def test_gate_and_normalized_rows(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("JS", "let a", "r")], "lang string, content string, repo string").write.parquet(a)
    spark.createDataFrame([(1,)], "x int").write.parquet(b)
    rows, skipped = readers.gated_parquet(spark, [a, b, str(tmp_path / "none")])
    assert [s[1].split(":")[0] for s in skipped] == ["missing_code_like_column", "unreadable"]
    assert readers.column_gate(["Code", "x"]) == "missing_language_like_column" and readers.column_gate([]) == "no_columns"
    assert readers.normalized_rows(rows).first()["language"] == "javascript"


def test_manifests(spark):
    rows = [
        ("web/package.json", '{"name": "web", "main": "./src/index.js", "dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}'),
        ("pyproject.toml", '[project]\nname = "svc"\ndependencies = ["FastAPI>=0.1", "x[y]"]\n[tool.poetry.dependencies]\npython = "3"\nNumpy = "1"'),
        ("requirements.txt", "# none\nflask==2 \n\nDjango ; python_version > '3'"),
        ("core/Cargo.toml", '[package]\nname = "core"\n[[bin]]\npath = "src/run.rs"'),
        ("pom.xml", "<artifactId>spring-boot</artifactId>"), ("a/App.csproj", "<x/>"), ("Dockerfile", "FROM x"), ("CMakeLists.txt", ""), ("setup.py", "install_requires=['flask']"),
        ("bad/package.json", "{"), ("bad/pyproject.toml", "= ="), ("a.py", "x"), ("none/package.json", None),
    ]
    got = {r["path"]: r for r in readers.manifest_facts(spark.createDataFrame(rows, "path string, content string")).collect()}
    facts = {k: (r["name"], r["dependencies"], r["frameworks"], r["project_types"], r["entry_points"]) for k, r in got.items()}
    assert facts == {
        "web/package.json": ("web", ["react", "vite"], ["React", "Vite"], ["Node.js", "React"], ["web/src/index.js"]),
        "pyproject.toml": ("svc", ["fastapi", "numpy", "x"], ["FastAPI"], ["FastAPI", "Python"], []),
        "requirements.txt": (None, ["django", "flask"], ["Django", "Flask"], ["Django", "Flask", "Python"], []),
        "core/Cargo.toml": ("core", [], [], ["Rust"], ["core/src/run.rs"]),
        "pom.xml": (None, [], ["Spring"], ["Java", "Java Maven", "Java Spring"], []), "a/App.csproj": (None, [], [], ["C# .NET"], []), "Dockerfile": (None, [], ["Docker"], [], []),
        "CMakeLists.txt": (None, [], ["CMake"], ["C++"], []), "setup.py": (None, ["flask"], ["Flask"], ["Flask", "Python"], []),
        "bad/package.json": (None, [], [], ["Node.js"], []), "bad/pyproject.toml": (None, [], [], ["Python"], []), "none/package.json": (None, [], [], ["Node.js"], []),
    }


def test_ingest(spark):
    raw = spark.createDataFrame([(str(i), "code_gen", "python", " " if i == 1 else "in", "out") for i in range(6)], "id string, objective string, language string, input string, output string")
    fill = lambda df: df.withColumns({"context": F.lit(""), "metadata": F.create_map(F.lit("s"), F.lit("t")), "ord": F.col("id").cast("long")})

    def fails(df):
        raise ValueError("no")

    def lost():
        raise OSError("gone")

    made = {"a": shape.Source(raw, fill, "code_gen", 3), "b": shape.Source(None, fill, "code_gen"), "c": shape.Source(raw, None, "code_gen"), "d": shape.Source(raw, fails, "code_gen"), "e": shape.Source(lost, fill, "code_gen"), "f": shape.Source(raw, fill, "none"), "g": shape.Source(lambda: raw.limit(0), fill, "code_gen")}
    rows, report = shape.ingest(spark, made, ["code_gen"])
    assert sorted((r["id"], r["reason"]) for r in rows.collect()) == [("0", None), ("1", "pipeline_blank_input"), ("2", None), ("3", None), ("4", shape.CAP_REASON), ("5", shape.CAP_REASON)]
    got = {r["dataset"]: r for r in report.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "success", "b": "missing_raw", "c": "converter_error", "d": "converter_error", "e": "load_failed", "f": "skipped", "g": "success"}
    a = got["a"]
    assert (a["raw"], a["kept"], a["dropped"], a["retention"], a["reasons"]) == (6, 3, 3, 0.5, {"pipeline_blank_input": 1, shape.CAP_REASON: 2})
    assert got["g"]["raw"] == 0 and got["g"]["reasons"] == {} and got["e"]["error"] == "gone"
    rows, report = shape.ingest(spark, {"b": made["b"]}, ["code_gen"])
    assert rows.count() == 0 and report.first()["kept"] == 0


def test_files_of_objectives(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id": "1", "input": "x"}\n\n{"id": "2", "objective": "other"}\n')
    (tmp_path / "a.jsonl").write_text('{"id": "3"}\n')
    files = [("code_gen", str(tmp_path / "b.jsonl")), ("bug_fix", str(tmp_path / "none.jsonl")), ("test_gen", str(tmp_path / "a.jsonl"))]
    got = readers.objective_files(spark, files).orderBy("ord").collect()
    assert [(r["id"], r["objective"]) for r in got] == [("1", "code_gen"), ("2", "code_gen"), ("3", "test_gen")]
    assert readers.objective_files(spark, files[1:2]).count() == 0


def test_lines_of_files_in_many_splits(spark, tmp_path):
    """A row's line is its number in the file, however the file is cut."""
    for name, n in (("a", 3000), ("b", 1), ("c", 700)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": str(i), "input": "x" * (i % 50)}) + "\n" for i in range(n)))
    files = [("code_gen", str(tmp_path / "c.jsonl")), ("bug_fix", str(tmp_path / "a.jsonl")), ("test_gen", str(tmp_path / "b.jsonl"))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = readers.objective_files(spark, files).select("objective", "id", "line", "ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(int(r["id"]) == r["line"] for r in got) and len(got) == 3701
    first = {"code_gen": 0, "bug_fix": 700, "test_gen": 3700}
    assert all(r["ord"] == first[r["objective"]] + r["line"] for r in got)


def test_buckets_are_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"v{i}", "a" if i % 10 else "b") for i in range(300)], "id long, v string, k string")
    store.create(rows, path, "id", 16)
    before = store.read(spark, path)
    names = lambda df: {r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect()}
    old = names(before)
    new = spark.createDataFrame([("x", "new", 5), ("a", "more", 1000)], "k string, v string, id long")
    touched = store.upsert(new, path)
    after = store.read(spark, path)
    assert 1 <= len(touched) <= 2 and len(old & names(after)) >= 14
    assert sorted(after.collect()) == sorted(vector.upsert(rows, new.select("id", "v", "k")).collect())
    assert sorted(before.collect()) == sorted(rows.collect()) == sorted(store.read(spark, path, 0).collect())
    assert store.delete_where(spark, path, {"k": "b", "v": "v10"}) and store.read(spark, path).count() == 300
    assert store.delete_where(spark, path, {"k": "nothing"}) == [] and store.upsert(new.limit(0), path) == []
    assert store.versions(spark, path) == [0, 1, 2] and store.vacuum(spark, path, 1) > 0 and store.versions(spark, path) == [2]
    assert store.read(spark, path).count() == 300
    store.delete_where(spark, path, {})
    assert store.read(spark, path).count() == 0 and store.read(spark, path).columns == ["id", "v", "k"]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    store.create(rows, path, "id", 4)
    manifest = store._manifest(spark, path)
    store.upsert(rows.where("id = 1").withColumn("v", F.lit("x")), path)
    monkeypatch.setattr(store, "_manifest", lambda *a: manifest)
    with pytest.raises(RuntimeError):
        store.upsert(rows.where("id = 2"), path)
    monkeypatch.undo()
    assert sorted(map(tuple, store.read(spark, path).collect())) == [(1, "x"), (2, "b")]


def test_only_files_and_checkpoints_are_plain_scans(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).write.parquet(path)
    files = spark.read.parquet(path)
    assert plain_scan(files) and plain_scan(files.where("id > 3").select((F.col("id") + 1).alias("x"))) and plain_scan(checkpointed(files.orderBy("id")))
    shuffled = spark.createDataFrame(files.rdd.repartition(3), "id long")
    for other in (shuffled, files.repartition(3), files.groupBy("id").count(), files.sample(0.5), files.limit(3), files.withColumn("n", F.expr("explode(array(1, 2))")), spark.createDataFrame([(1,)], "x int")):
        assert not plain_scan(other)


def test_raw_folders(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "raw.jsonl").write_text('{"a": 1}\n{"b": 2}\n')
    spark.range(3).write.parquet(str(tmp_path / "s" / "train"))
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "s" / "test"))
    spark.range(4).write.parquet(str(tmp_path / "p"))
    found = {k: readers.raw_dataset(spark, str(tmp_path / k)) for k in "jspn"}
    assert {k: v[0] for k, v in found.items()} == {"j": "jsonl", "s": "splits", "p": "parquet", "n": "missing"}
    assert [readers.probe(found[k][1])[:2] for k in "jsp"] == [(2, ["a", "b"]), (5, ["id", "x"]), (4, ["id"])]


def test_valid_text(spark):
    rows = [(1, bytearray(b"ok")), (2, bytearray(b"\xed\xa0\x80")), (3, bytearray("é".encode()[:1])), (4, None), (5, bytearray())]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(rows, "i int, b binary").select("i", filters.encodable("b").alias("v")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}
    df = spark.createDataFrame([("python", "x = (", "y = 1", None), ("python", "x = (", "", None), ("java", "f({)}", "g()", ""), (None, None, None, None)], "language string, input string, context string, output string")
    assert [r["kept"] for r in filters.any_parses(df.coalesce(1)).collect()] == [True, False, True, False]


def test_payloads_hold_all_that_a_chunk_is_found_by(spark):
    code = "import os\n\n\ndef run(a):\n    return helper(os.getcwd())\n"
    rows = [("src/core/run.py", "python", code, "s1"), ("tests/test_run.py", "python", "from core import run\n\n\ndef test_run():\n    run(1)\n", "s2"), ("README.md", "markdown", "# Title\ntext\n", "s3"), ("empty.py", "python", "", "s4")]
    files = spark.createDataFrame(rows, "path string, language string, content string, sha256 string")
    edges = spark.createDataFrame([("tests/test_run.py", "src/core/run.py", "FILE_IMPORTS_FILE"), ("tests/test_run.py", "src/core/run.py", "TEST_COVERS_FILE")], "src string, dst string, relation string")
    near = index.adjacency(edges)
    got = {r["relative_path"]: r.asDict() for r in index.payloads(files, "/w/My App/", graph.signals(files, edges), near).collect()}
    assert set(got) == {"src/core/run.py", "tests/test_run.py", "README.md"}
    r = got["src/core/run.py"]
    assert (r["project_name"], r["project_path"], r["file_path"], r["folder"], r["language"]) == ("My App", "/w/My App", "/w/My App/src/core/run.py", "src/core", "python")
    assert (r["chunk_type"], r["symbol_name"], r["start_line"], r["end_line"], r["imports"], r["called_functions"]) == ("function", "run", 4, 5, ["import os"], ["helper", "getcwd"])
    assert (r["imported_by_count"], r["dependency_neighbors"], r["is_test_file"], r["source"], r["validated"], len(r["id"])) == (1, ["tests/test_run.py"], False, "project_code", True, 36)
    assert got["tests/test_run.py"]["is_test_file"] and got["README.md"]["is_doc_file"] and got["README.md"]["folder"] == "." and got["README.md"]["symbol_name"] == "Title"
    assert {x["path"]: x["related_tests"] for x in near.collect()}["src/core/run.py"] == ["tests/test_run.py"]
    summary = {x["relative_path"]: x["content"] for x in index.file_rows(files, "/w/My App", near).collect()}
    assert summary["tests/test_run.py"] == "File: tests/test_run.py\nLanguage: python\nLines: 5\nPurpose: Source file.\nFunctions: test_run\nDependencies: src/core/run.py"
    points = index.embedded(index.payloads(files, "/w/My App"), 8)
    assert all(len(x["vector"]) == 8 for x in points.collect())


def test_caps_on_hot_nodes(spark):
    edges = spark.range(500).select(F.concat(F.lit("f"), F.lpad("id", 3, "0")).alias("src"), F.lit("hub").alias("dst"), F.lit("FILE_IMPORTS_FILE").alias("relation"))
    hub = index.adjacency(edges).where("path = 'hub'").first()
    assert hub["imported_by"] == [f"f{i:03d}" for i in range(30)] == hub["neighbors"] and hub["imports"] == []


def test_a_stopped_ingest_keeps_its_cap(spark, tmp_path):
    """Two runs from one checkpoint: the second one goes on at the count of the first."""
    src, args = str(tmp_path / "in"), (str(tmp_path / "c"), str(tmp_path / "o"), lambda df: df.where("id % 2 = 0"), 30)
    spark.range(0, 40).coalesce(1).write.parquet(src)
    assert streams.ingested(streams.source(spark, src), *args) == 20
    spark.range(40, 140).coalesce(1).write.mode("append").parquet(src)
    assert streams.ingested(streams.source(spark, src), *args) == 30
    spark.range(140, 200).coalesce(1).write.mode("append").parquet(src)
    assert streams.ingested(streams.source(spark, src), *args) == 30 and spark.read.parquet(args[1]).count() == 30


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    """Rows of three files, one a batch: 00:05 comes again after the watermark has passed its hour, and doesn't count."""
    src, rows = str(tmp_path / "in"), [["2024-01-01 00:05:00", "2024-01-01 00:50:00", "2024-01-01 01:10:00"], ["2024-01-01 05:00:00"], ["2024-01-01 00:05:00", "2024-01-01 05:30:00"], ["2024-01-01 09:00:00"]]
    for part in rows:
        spark.createDataFrame([(t,) for t in part], "t string").select(F.to_timestamp("t").alias("ts"), F.lit("a").alias("k")).coalesce(1).write.mode("append").parquet(src)
    held = streams.windowed(streams.source(spark, src), "ts", "1 hour", "10 minutes", "k").select(F.date_format("window.start", "HH:mm").alias("start"), "k", "n")
    got = streams.collected(held, str(tmp_path / "c"), str(tmp_path / "o"))
    assert sorted((r["start"], r["n"]) for r in got.collect()) == [("00:00", 2), ("01:00", 1), ("05:00", 2)]


def test_no_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from corpusloom import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch(far, "x")


def test_swap_and_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    writers.swapped(spark.range(3), p)
    writers.swapped(spark.range(5), p)
    assert spark.read.parquet(p).count() == 5 and not os.path.exists(p + ".old")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("val"))
    writers.partitioned(df, str(tmp_path / "s"), "split")
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'val'").count() == 3
    writers.report(df.groupBy("split").count(), str(tmp_path / "r"))
    assert sum(x["count"] for x in json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "r"), wholetext=True).collect()))) == 10


def test_streaming_dedup_goes_on_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k, "same"), (k + 10, f"t{k}")], "id long, text string").coalesce(1).write.mode("append").parquet(src)
    held = streams.deduplicated(streams.source(spark, src), ["text"])
    assert streams.collected(held.select("text"), str(tmp_path / "c"), str(tmp_path / "o")).count() == 4


def test_reindex(spark):
    files = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y\nz"), ("d", "4", "w")], "path string, sha256 string, content string")
    state = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "3")], "path string, sha256 string")
    index = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "path string, chunk string")
    chunks = lambda f: chunk.line_windows(f.select("path", "content")).select("path", "chunk")
    got, now = streams.reindexed(files, state, index, chunks)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "old"), ("b", "y\nz"), ("d", "w")] and now.count() == 3


def test_vectors_and_labels(spark, tmp_path):
    from corpusloom.operators import training

    (tmp_path / "v.jsonl").write_text('{"id": "a", "vector": [1.0], "payload": {"k": "1"}}\n{"id": "b", "vector": [2.0]}\n{"id": "a", "vector": [3.0]}\n')
    got = {r["id"]: r["vector"] for r in readers.vectors(spark, str(tmp_path / "v.jsonl")).collect()}
    assert got == {"a": [3.0], "b": [2.0]}
    df = spark.createDataFrame([("ab", "c"), ("abcdef", "g"), (None, None)], "p string, a string")
    rows = training.labelled(df, "p", "a", 5).collect()
    assert [r["labels"] for r in rows] == [[-100, -100, 100, -100, -100], [-100] * 5, [-100] * 5]
    assert [r["attention_mask"] for r in rows] == [[1, 1, 1, 0, 0], [1] * 5, [0] * 5] and rows[0]["input_ids"] == [98, 99, 100, 0, 0]


def test_a_stream_of_files_is_indexed_by_content(spark, tmp_path):
    """Three batches: new files, one of them again as it was, one changed; then a second run goes on."""
    src, args = str(tmp_path / "in"), (str(tmp_path / "c"), str(tmp_path / "o"))
    made = []

    def chunks(df):
        made.append(sorted(r["path"] for r in df.collect()))
        return chunk.line_windows(df.select("path", "content")).select("path", "chunk")

    put = lambda rows: spark.createDataFrame([(p, str(hash(c)), c) for p, c in rows], "path string, sha256 string, content string").coalesce(1).write.mode("append").parquet(src)
    put([("a", "1"), ("b", "2")])
    streams.indexing(streams.source(spark, src), *args, chunks)
    put([("a", "1"), ("b", "3\n4"), ("c", "5")])
    streams.indexing(streams.source(spark, src), *args, chunks)
    put([("c", "5")])
    streams.indexing(streams.source(spark, src), *args, chunks)
    index, state = streams.indexed(spark, args[1])
    assert made == [["a", "b"], ["b", "c"], []]
    assert sorted(map(tuple, index.collect())) == [("a", "1"), ("b", "3\n4"), ("c", "5")] and state.count() == 3


def test_large_folders_have_several_rows(spark):
    files = spark.range(2500).select(F.concat(F.lit("big/"), F.lpad("id", 4, "0")).alias("path")).unionByName(spark.createDataFrame([("one.py",), ("small/a",), ("small/b",)], "path string"))
    got = index.folder_rows(files, "/w", 1000).collect()
    big = [r for r in got if r["relative_path"] == "big"]
    assert len(big) == 3 and len({r["id"] for r in got}) == len(got) == 5
    assert sorted(x for r in big for x in r["content"].split("\n- ")[1:]) == [f"big/{i:04d}" for i in range(2500)]
    assert {r["relative_path"]: r["content"] for r in got}["small"] == "Folder: small\nContains:\n- small/a\n- small/b"
