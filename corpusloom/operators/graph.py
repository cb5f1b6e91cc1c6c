"""Dependency graphs: resolving references between files, degrees, importance, project facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..session import checkpointed, plain_scan

# Fixed values
CANDIDATE_ENDS = ["", ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".cs", ".cpp", ".hpp", ".h", ".rs", "/index.js", "/index.ts", "/mod.rs"]
TEST_ENDS, TEST_MARKS = r"\.(py|js|ts|tsx|jsx|java|cs|rs|cpp|cc)$", r"(^test_|_test$|\.test$|\.spec$|^test)"


def module_of(path: Column | str) -> Column:
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(F.coalesce(parent, F.lit("")) == "", "(root)").otherwise(parent)


def _joined(folder: Column, ref: Column) -> Column:
    """ref from folder, with . and .. taken out."""
    parts = F.filter(F.split(F.concat_ws("/", folder, ref), "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(up, "/")


def resolve(files: DataFrame) -> DataFrame:
    """(src, dst, relation): each reference of files (path, language, content) to the first candidate path that is a file.

    All references are found, once, and cut from their plan. Candidates are equi-joined, and the one of the lowest rank wins; a reference without any goes to the smallest path
    whose stem is its last name.
    """
    refs = checkpointed(files.select(F.col("path").alias("src"), F.explode(C.references("content", "language", most=None)).alias("ref")))
    folder = F.regexp_replace(F.regexp_extract("src", r"^(.*)/[^/]*$", 1), "^$", "")
    relative, dotted = _joined(folder, F.col("ref")), F.replace(F.replace(F.col("ref"), F.lit("."), F.lit("/")), F.lit("\\"), F.lit("/"))
    bases = F.when(F.col("ref").startswith("."), F.array(relative)).when(F.col("ref").startswith("/"), F.array(_joined(F.lit(""), F.col("ref")))).otherwise(F.array(dotted, F.element_at(F.split(dotted, "/"), -1)))
    ends = F.array(*[F.lit(e) for e in CANDIDATE_ENDS])
    paths = F.flatten(F.transform(bases, lambda b: F.transform(ends, lambda e: F.concat(F.regexp_replace(b, r"^[./]+|[./]+$", ""), e))))
    tried = refs.select("src", "ref", F.posexplode(paths).alias("rank", "dst"))
    known = files.select(F.col("path").alias("dst"))
    hits = tried.join(known, "dst").groupBy("src", "ref").agg(F.min_by("dst", "rank").alias("dst"))
    stem = lambda p: F.lower(F.regexp_extract(p, r"([^/]+?)(\.[^./]*)?$", 1))
    stems = files.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("dst"))
    rest = refs.join(hits, ["src", "ref"], "left_anti")
    rest = rest.withColumn("stem", F.lower(F.element_at(F.split(F.element_at(F.split("ref", "/"), -1), r"\."), 1)))
    found = hits.select("src", "dst").unionByName(rest.join(stems, "stem").select("src", "dst"))
    return found.where("src <> dst").distinct().withColumn("relation", F.lit("FILE_IMPORTS_FILE"))


def symbols_of(files: DataFrame) -> DataFrame:
    """(path, classes, functions, calls, routes, entry) of files (path, language, content), parsed once and cut from their plan. Lists are whole."""
    s = C.structure_of("content", "language")
    held = files.select("path", s.alias("s"), C.called_functions("content", "language").alias("calls"), C.routes("content", "language").alias("routes"), C.is_entry("path", "content", "language").alias("entry"))
    return checkpointed(held.select("path", "s.classes", "s.functions", "calls", "routes", "entry"))


def _classes(held: DataFrame) -> DataFrame:
    return held.select("path", F.explode("classes").alias("c")).select("path", "c.name", "c.bases")


def _homes(held: DataFrame) -> DataFrame:
    """(name, home) of functions that one file alone defines."""
    return held.select("path", F.explode("functions").alias("name")).groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("home")).where("n = 1").drop("n")


def calls_of(held: DataFrame) -> DataFrame:
    """(path, name, home): calls of functions that one other file alone defines."""
    return held.select("path", F.explode("calls").alias("name")).join(_homes(held), "name").where("path <> home").select("path", "name", "home")


def bases_of(held: DataFrame) -> DataFrame:
    """(path, base, home): classes' bases that another file defines; of several the smallest path."""
    classes = _classes(held)
    homes = classes.groupBy(F.col("name").alias("base")).agg(F.min("path").alias("home"))
    return classes.select("path", F.explode("bases").alias("base")).join(homes, "base").where("path <> home").select("path", "base", "home").distinct()


def symbol_edges(held: DataFrame) -> DataFrame:
    """(src, dst, relation) of symbols_of's rows: bases, functions' files, calls, entry points' modules, routes' handlers."""
    edge = lambda df, src, dst, kind: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("relation"))
    out = edge(_classes(held).select("name", F.explode("bases").alias("base")), "name", "base", "CLASS_INHERITS_CLASS")
    out = out.unionByName(edge(held.select("path", F.explode("functions").alias("name")), "name", "path", "FUNCTION_BELONGS_TO_FILE"))
    out = out.unionByName(edge(calls_of(held), "path", "name", "FUNCTION_CALLS_FUNCTION"))
    out = out.unionByName(edge(held.where("entry").select("path", module_of("path").alias("module")), "path", "module", "ENTRYPOINT_STARTS_MODULE"))
    routes = held.select(F.explode("routes").alias("r")).select(F.concat_ws(" ", "r.method", "r.path").alias("route"), "r.handler")
    return out.unionByName(edge(routes, "route", "handler", "API_ROUTE_CALLS_HANDLER"))


def test_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, TEST_COVERS_FILE): what a test imports that is no test, or else up to three files of its stem. Files are cut to three a stem before they meet the tests."""
    marked = files.select("path", C.is_test("path").alias("test"))
    tests, others = marked.where("test").select(F.col("path").alias("src")), marked.where("not test").select(F.col("path").alias("dst"))
    direct = imports.select("src", "dst").join(tests, "src", "left_semi").join(others, "dst", "left_semi").select("src", "dst")
    stem = F.regexp_replace(F.regexp_replace(C.name_of("src"), TEST_ENDS, ""), TEST_MARKS, "")
    rest = tests.join(direct, "src", "left_anti").select("src", F.btrim(stem, F.lit("_.")).alias("stem")).where("stem <> ''")
    named = others.select("dst", F.lower(F.regexp_extract("dst", r"([^/]+?)(\.[^./]*)?$", 1)).alias("stem"))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy("dst"))).where("n <= 3")
    near = rest.join(first, "stem").select("src", "dst")
    return direct.unionByName(near).distinct().withColumn("relation", F.lit("TEST_COVERS_FILE"))


def build(files: DataFrame) -> DataFrame:
    """(src, dst, relation): all edges of files (path, language, content), each once; none leads to itself."""
    held, imports = symbols_of(files), checkpointed(resolve(files))
    modules = imports.select(module_of("src").alias("src"), module_of("dst").alias("dst"), F.lit("MODULE_DEPENDS_ON_MODULE").alias("relation"))
    tests = checkpointed(test_edges(files, imports))
    defined = held.select(F.col("path").alias("dst"), F.explode("functions").alias("name"))
    called = held.select(F.col("path").alias("src"), F.explode("calls").alias("name"))
    covered = tests.select("src", "dst").join(defined, "dst").join(called, ["src", "name"]).select("src", F.col("name").alias("dst"), F.lit("TEST_COVERS_FUNCTION").alias("relation"))
    out = imports.unionByName(modules).unionByName(symbol_edges(held)).unionByName(tests).unionByName(covered)
    return out.where("src <> '' and dst <> '' and src <> dst").distinct()


def importers(edges: DataFrame, most: int = 15, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, n, sources): how many nodes lead to each, and the first most of them."""
    pairs = edges.select(F.col(dst).alias("node"), F.col(src).alias("value")).distinct()
    place = F.row_number().over(Window.partitionBy("node").orderBy("value"))
    first = pairs.withColumn("k", place).where(F.col("k") <= most).groupBy("node").agg(F.sort_array(F.collect_list("value")).alias("sources"))
    return pairs.groupBy("node").agg(F.count("*").alias("n")).join(first, "node")


def hotspots(edges: DataFrame, most: int = 8) -> DataFrame:
    """(node, degree): the nodes that others lead to, of most edges either way."""
    return degrees(edges).where("n_in > 0").orderBy(F.desc("degree"), "node").limit(most).select("node", "degree")


def module_degrees(edges: DataFrame) -> DataFrame:
    """(module, degree): degrees summed over the nodes of a folder."""
    return degrees(edges).groupBy(module_of("node").alias("module")).agg(F.sum("degree").alias("degree"))


# How long lists are in a short view of a project
CAPS = {"files": 15, "tests": 10, "symbols": 20, "functions": 30, "routes": 80, "edges": 4000}


def stored(edges: DataFrame, most: int = CAPS["edges"]) -> DataFrame:
    """The edges that are kept with a project, in order; counts by relation are taken from all of them."""
    return edges.orderBy("relation", "src", "dst").limit(most)


def _listed(rows: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """(path, name): the distinct values of rows (path, rank, value) by rank, then value; with most the first of them, and rows beyond are cut in each task."""
    held = rows.where("value is not null and value <> path").groupBy("path", "value").agg(F.min("rank").alias("rank"))
    if most is not None:
        place = F.row_number().over(Window.partitionBy("path").orderBy("rank", "value"))
        held = held.withColumn("n", place).where(F.col("n") <= most)
    return held.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias(name))


def _heirs(classes: DataFrame) -> DataFrame:
    """(path, child_classes): the classes that have one of the file's own as a base, sorted. They are listed once a base, and lists meet the files, not each heir each file."""
    heirs = classes.select(F.col("name").alias("value"), F.explode("bases").alias("base")).groupBy("base").agg(F.collect_set("value").alias("values"))
    met = classes.select("path", F.col("name").alias("base")).distinct().join(heirs, "base").groupBy("path").agg(F.flatten(F.collect_list("values")).alias("values"))
    return met.select("path", F.array_remove(F.array_sort(F.array_distinct("values")), F.col("path")).alias("child_classes"))


def relations(files: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """A row a file: imports, imported_by, related_files, related_tests, related_symbols, dependency_count, call_count, classes,
    functions, parent_classes, child_classes. Lists are whole; with caps (CAPS) those of files, tests, symbols and functions
    are cut, counts and classes are not.

    Related are, in this order, what a file imports, what imports it, its tests, files of its classes' bases, files whose
    classes have its own as bases, and files that it calls.
    """
    held, imports = symbols_of(files), checkpointed(resolve(files).select("src", "dst"))
    tests = test_edges(files, imports).select("src", "dst")
    bases, calls = bases_of(held), calls_of(held)
    pair = lambda df, path, value, rank: df.select(F.col(path).alias("path"), F.lit(rank).alias("rank"), F.col(value).alias("value"))
    out_of, into, tested = pair(imports, "src", "dst", 0), pair(imports, "dst", "src", 1), pair(tests, "dst", "src", 2)
    related = out_of.unionByName(into).unionByName(tested).unionByName(pair(bases, "path", "home", 3)).unionByName(pair(bases, "home", "path", 4)).unionByName(pair(calls, "path", "home", 5))
    classes = _classes(held)
    parents = classes.select("path", F.lit(0).alias("rank"), F.explode("bases").alias("value"))
    listed = F.concat(F.transform("classes", lambda c: c["name"]), "functions")
    own = held.select("path", F.posexplode(listed).alias("rank", "value")).unionByName(parents.withColumn("rank", F.lit(1 << 30)))
    counts = out_of.unionByName(into).groupBy("path").agg(F.count_distinct("rank", "value").alias("dependency_count"))
    caps = caps or {}
    functions = F.slice("functions", 1, caps["functions"]) if "functions" in caps else F.col("functions")
    out = held.select("path", F.size("calls").cast("long").alias("call_count"), F.transform("classes", lambda c: c["name"]).alias("classes"), functions.alias("functions"))
    lists = {"imports": (out_of, "files"), "imported_by": (into, "files"), "related_files": (related, "files"), "related_tests": (tested, "tests"), "related_symbols": (own, "symbols"), "parent_classes": (parents, "classes")}
    for name, (rows, kind) in lists.items():
        out = out.join(_listed(rows, name, caps.get(kind)), "path", "left")
    none = F.array().cast("array<string>")
    out = out.join(_heirs(classes), "path", "left").join(counts, "path", "left").withColumns({c: F.coalesce(c, none) for c in [*lists, "child_classes"]})
    return out.withColumn("dependency_count", F.coalesce("dependency_count", F.lit(0)))


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, n_out, n_in, degree) over distinct edges."""
    both = edges.select(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return out.withColumn("degree", F.col("n_out") + F.col("n_in"))


def signals(files: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per file: language, counts, flags and importance."""
    imports = edges.where("relation = 'FILE_IMPORTS_FILE'")
    counts = degrees(imports)
    held = files.join(counts, files.path == counts.node, "left").select(
        "path", "language",
        F.coalesce("n_out", F.lit(0)).alias("import_count"), F.coalesce("n_in", F.lit(0)).alias("imported_by_count"),
        C.symbol_count("content").alias("symbol_count"), C.is_entry("path", "content", "language").alias("is_entry_point"),
        C.is_config("path", "language").alias("is_config_file"), C.is_doc("path", "language").alias("is_doc_file"), C.is_test("path").alias("is_test_file"),
        C.frameworks("content", "language").alias("frameworks"),
    )
    score = C.importance("path", "import_count", "imported_by_count", "symbol_count", "is_entry_point", "is_config_file", "is_doc_file", "is_test_file")
    return held.withColumn("importance_score", score)


def project(signals: DataFrame) -> DataFrame:
    """One row of project facts: types, frameworks, languages, files that matter. Signals are read four times, so what isn't a plain scan is cut first."""
    if not plain_scan(signals):
        signals = checkpointed(signals.select("path", "language", "frameworks", "is_entry_point", "importance_score"))
    types = F.create_map(*[F.lit(x) for kv in C.PROJECT_TYPES.items() for x in kv])
    langs = signals.groupBy("language").agg(F.count("*").alias("n"))
    summary = langs.agg(
        F.sort_array(F.array_distinct(F.array_compact(F.collect_list(F.try_element_at(types, F.col("language")))))).alias("project_types"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"),
    )
    flat = signals.select(F.explode_outer("frameworks").alias("f")).agg(F.sort_array(F.collect_set("f")).alias("frameworks"))
    top = signals.where("importance_score > 0").orderBy(F.desc("importance_score"), "path").limit(80)
    important = top.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("importance_score")).alias("s"), "path"))), lambda x: x["path"]).alias("important_files"))
    entries = signals.where("is_entry_point").agg(F.sort_array(F.collect_list("path")).alias("entry_points"))
    return summary.crossJoin(flat).crossJoin(important).crossJoin(entries)


# Fixed values
ECOSYSTEMS = (("Python", "FastAPI", "Flask", "Django"), ("Node.js", "React", "Angular", "Vue"), ("Java", "Java Spring", "C# .NET", "C++", "Rust"))


def workspace(files: DataFrame, frameworks: DataFrame | None = None) -> DataFrame:
    """One row: project_types, frameworks, mixed (types of two ecosystems or more) and a summary, of files (language).

    frameworks has a list column of that name, and may have project_types too; both are united with what languages say.
    Languages are named by number of files, then by name.
    """
    types = F.create_map(*[F.lit(x) for kv in C.PROJECT_TYPES.items() for x in kv])
    langs = files.groupBy("language").agg(F.count("*").alias("n"))
    out = langs.agg(F.array_compact(F.collect_list(F.try_element_at(types, F.col("language")))).alias("t"), F.sort_array(F.collect_list(F.when(F.col("language").isNotNull(), F.struct((-F.col("n")).alias("n"), "language")))).alias("l"))
    none = F.array().cast("array<string>")
    if frameworks is None:
        out = out.withColumns({"f": none, "p": none})
    else:
        more = F.col("project_types") if "project_types" in frameworks.columns else none
        listed = frameworks.select(F.coalesce("frameworks", none).alias("f"), F.coalesce(more, none).alias("p"))
        listed = listed.select(F.explode(F.concat(F.transform("f", lambda x: F.struct(F.lit("f").alias("k"), x.alias("v"))), F.transform("p", lambda x: F.struct(F.lit("p").alias("k"), x.alias("v"))))).alias("x")).distinct()
        found = listed.agg(F.collect_set(F.when(F.col("x.k") == "f", F.col("x.v"))).alias("f"), F.collect_set(F.when(F.col("x.k") == "p", F.col("x.v"))).alias("p"))
        out = out.crossJoin(F.broadcast(found))
    out = out.select(F.array_sort(F.array_distinct(F.concat("t", "p"))).alias("project_types"), F.array_sort("f").alias("frameworks"), "l")
    met = lambda group: F.arrays_overlap("project_types", F.array(*[F.lit(x) for x in group])).cast("int")
    label = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    counted = F.transform("l", lambda x: F.concat(x["language"], F.lit("="), (-x["n"]).cast("string")))
    text = F.concat(label("project_types", "unknown/generic project"), F.lit(". Frameworks: "), label("frameworks", "none detected"), F.lit(". Languages: "), label(counted, "unknown"), F.lit("."))
    return out.select("project_types", "frameworks", (sum((met(g) for g in ECOSYSTEMS[1:]), met(ECOSYSTEMS[0])) >= 2).alias("mixed"), text.alias("summary"))
