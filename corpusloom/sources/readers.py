"""Sources: JSON lines strict and tolerant, objective folders, Parquet with a schema gate, source trees, manifests, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import code as C
from ..functions import text as X
from ..session import checkpointed
from . import trees

# Fixed values
CODE_COLUMNS = ("code", "content", "before", "after", "text", "func", "func_code_string", "whole_func_string")
LANGUAGE_COLUMNS = ("language", "lang", "programming_language")

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "objective", "language", "input", "output", "context", "split")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Every line is an object of the schema, or the read fails. Blank lines are passed over; NaN and Infinity are errors."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines): lines that are no object of the schema are set apart. Both read the lines once each."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("value")


def objectives(spark: SparkSession, top: str, schema: T.StructType = RECORD) -> DataFrame:
    """All JSON lines below top/<objective>/; the folder's name is the objective. A folder without files gives no rows."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(top)
    return rows.withColumn("objective", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))


def objective_files(spark: SparkSession, files: list[tuple[str, str]], schema: T.StructType = RECORD) -> DataFrame:
    """The records of (objective, path) JSON lines files in the given order: objective is the file's, line its row's number in it, ord numbers all rows.

    A path that isn't there gives no rows. Files of any size are read in splits, in any number: each split's rows are counted, and
    a row's line is what the splits before its own hold, and its place there.
    """
    there = [(i, o, p) for i, (o, p) in enumerate(files) if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema).withColumns({"line": F.lit(0).cast("long"), "ord": F.lit(0).cast("long")})
    out = None
    for i, objective, path in there:
        place = {"objective": F.lit(objective), "__file": F.lit(i), "__path": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()}
        one = spark.read.schema(schema).json(path).withColumns(place)
        out = one if out is None else out.unionByName(one)
    rows = checkpointed(out)
    counts = rows.groupBy("__file", "__path", "__start").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*[c for c in ("__file", "__path", "__start") if c not in by]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumns({"__line": before("__file"), "__ord": before()}).drop("n")
    held = rows.join(F.broadcast(starts), ["__file", "__path", "__start"])
    place = F.col("__id") - F.col("__first")
    return held.withColumns({"line": F.col("__line") + place, "ord": F.col("__ord") + place}).drop("__file", "__path", "__start", "__id", "__first", "__line", "__ord")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path, on any file system Spark knows."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The Parquet splits of a saved dataset as one table; columns that a split lacks are null."""
    out = None
    for p in paths:
        one = spark.read.parquet(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def column_gate(columns: list[str]) -> str:
    """ok, or what the columns of a raw table lack: no_columns, missing_code_like_column, missing_language_like_column."""
    names = {c.lower() for c in columns}
    if not names:
        return "no_columns"
    if not names & set(CODE_COLUMNS):
        return "missing_code_like_column"
    return "ok" if names & set(LANGUAGE_COLUMNS) else "missing_language_like_column"


def gated_parquet(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(rows, skipped): files that have a code column and a language column; the others with why not.

    Only footers decide; the driver reads several at once.
    """
    good, skipped = [], []
    for path, gate in _footers(spark, paths):
        if gate == "ok":
            good.append(path)
        else:
            skipped.append((path, gate))
    return (splits(spark, good) if good else None), skipped


def _footers(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(path, gate) of each path, in order."""
    from concurrent.futures import ThreadPoolExecutor

    def one(path: str) -> tuple[str, str]:
        try:
            return path, column_gate(spark.read.parquet(path).columns)
        except Exception as e:
            return path, f"unreadable: {type(e).__name__}"

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(one, paths))


def select_files(files: DataFrame, languages: list[str] = (), suffix: str = ".jsonl", folder: str | None = None, name: str | None = None) -> DataFrame:
    """The files (path) of a remote listing that a source needs.

    folder: a top folder whose next part names the language (data/<language>/...); without it a language counts if any
    part of the path is its name. name: the file's own name, if it must have one. Without languages all count.
    """
    held = files.where(F.col("path").endswith(suffix))
    wanted = [X.alias_language(F.lit(x)) for x in languages]
    parts = F.split("path", "/")
    if folder is not None:
        held = held.where(F.col("path").startswith(folder + "/") & (F.size(parts) >= 3))
        if name is not None:
            held = held.where(F.element_at(parts, -1) == name)
        return held.where(F.array_contains(F.array(*wanted), X.alias_language(F.get(parts, 1)))) if languages else held
    if name is not None:
        held = held.where(F.element_at(parts, -1) == name)
    return held.where(F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*wanted))) if languages else held


def raw_dir(configs: DataFrame) -> DataFrame:
    """(name, raw_dir) of configs (name, raw_dir_name, reuse_raw_from): the parent's folder where it is reused, else its own, else its name."""
    own = F.coalesce(F.nullif("raw_dir_name", F.lit("")), F.col("name"))
    parents = configs.select(F.col("name").alias("parent"), own.alias("__dir"))
    held = configs.join(parents, configs["reuse_raw_from"] == F.col("parent"), "left")
    lost = F.coalesce(F.nullif("reuse_raw_from", F.lit("")), own)
    return held.select("name", F.coalesce("__dir", lost).alias("raw_dir"))


def normalized_rows(df: DataFrame) -> DataFrame:
    """Raw rows with the aliases of language, before, after, code, repo and path as one column each."""
    names = df.columns
    first = lambda *c: X.first_present(list(c), names)
    out = df.select(
        first(*LANGUAGE_COLUMNS).alias("raw_language"), first("before", "old_contents", "buggy").alias("before"), first("after", "new_contents", "fixed").alias("after"),
        first(*CODE_COLUMNS).alias("code"), first("repo", "repository", "repo_name", "repository_name").alias("repo"), first("path", "file_path", "func_path_in_repository").alias("path"),
    )
    found = F.when(F.col("raw_language") != "", X.alias_language("raw_language")).otherwise(C.language("path", "code"))
    code = F.when(F.col("code") != "", F.col("code")).when(F.col("after") != "", F.col("after")).otherwise(F.col("before"))
    return out.select(found.alias("language"), "before", "after", code.alias("code"), "repo", "path")


def tree(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Files below root, hidden ones too, outside of excluded folders: path (relative), length, sha256, skip, language, content (text, where not skipped).

    max_files: the rows up to the indexed file of that number, by path. See trees.scan() for what is skipped, and why.
    """
    return trees.texts(trees.first_files(spark, root, max_files) if max_files else trees.scan(spark, root))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and bytes below path, hidden ones too. The file system counts them; contents aren't read."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    told = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(top)
    return spark.range(1).select(F.lit(told.getFileCount()).cast("long").alias("files"), F.lit(told.getLength()).cast("long").alias("bytes"))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: all lines, and those that aren't blank."""
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.count_if(F.trim("value") != "").alias("filled"))


MANIFESTS = ("package.json", "angular.json", "pyproject.toml", "requirements.txt", "setup.py", "pom.xml", "build.gradle", "build.gradle.kts", "cmakelists.txt", "cargo.toml", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
NODE_FRAMEWORKS = {"react": "React", "@angular/core": "Angular", "vue": "Vue", "vite": "Vite", "express": "Express"}
PYTHON_FRAMEWORKS = {"fastapi": "FastAPI", "flask": "Flask", "django": "Django"}


def manifest_facts(files: DataFrame) -> DataFrame:
    """(path, name, dependencies, frameworks, project_types, entry_points) of the manifests among files (path, content).

    Dependencies are in lower case, without versions, sorted: of package.json all three lists, of requirements a line
    each, of pyproject the project's and poetry's, of setup.py the known frameworks that it names. A text that doesn't
    parse has none. Entry points are main and bin paths, beside the manifest's folder.
    """
    none = F.array().cast("array<string>")
    name, text = C.name_of("path"), F.coalesce("content", F.lit(""))
    low = F.lower(text)
    known = name.isin(*MANIFESTS) | name.rlike(r"\.csproj$|^vite\.config")
    bare = lambda x: F.trim(F.element_at(F.split(F.lower(x), r"[<>=~!;\[]"), 1))
    held = files.where(known).select("path", name.alias("__name"), low.alias("__low"), text.alias("__text"))
    name = F.col("__name")
    toml = F.when(name.isin("pyproject.toml", "cargo.toml"), F.col("__text"))
    held = held.withColumn("__toml", C.toml_lists(toml))
    project = F.concat(F.transform("__toml.dependencies", bare), F.filter(F.transform("__toml.poetry", F.lower), lambda x: x != "python"))
    named = F.array_compact(F.array(*[F.when(F.col("__low").contains(k), k) for k in PYTHON_FRAMEWORKS]))
    content = F.col("__text")
    deps = F.when(name == "package.json", _node_dependencies(content)).when(name == "requirements.txt", _requirements(content, bare)).when(name == "pyproject.toml", project).when(name == "setup.py", named).otherwise(none)
    held = held.withColumn("dependencies", F.array_sort(F.array_distinct(F.coalesce(deps, none))))
    has = lambda table: F.array_compact(F.array(*[F.when(F.array_contains("dependencies", k), v) for k, v in table.items()]))
    java = name.isin("pom.xml", "build.gradle", "build.gradle.kts")
    spring = java & (F.col("__low").contains("spring-boot") | F.col("__low").contains("org.springframework"))
    python = name.isin("pyproject.toml", "requirements.txt", "setup.py")
    one = lambda condition, *values: F.when(condition, F.array(*[F.lit(v) for v in values])).otherwise(none)
    frames = F.concat(
        F.when(name == "package.json", has(NODE_FRAMEWORKS)).otherwise(none), F.when(python, has(PYTHON_FRAMEWORKS)).otherwise(none), one(name == "angular.json", "Angular"), one(name.startswith("vite.config"), "Vite"),
        one(spring, "Spring"), one(name == "cmakelists.txt", "CMake"), one(name.rlike("^(dockerfile|(docker-)?compose\\.ya?ml)$"), "Docker"),
    )
    held = held.withColumn("frameworks", F.array_sort(F.array_distinct(frames)))
    types = F.concat(
        one(name == "package.json", "Node.js"), F.filter(F.when(name.isin("package.json", "angular.json"), F.col("frameworks")).otherwise(none), lambda x: x.isin("React", "Angular", "Vue")),
        one(python, "Python"), F.when(python, F.col("frameworks")).otherwise(none), one(java, "Java"), one(name == "pom.xml", "Java Maven"), one(spring, "Java Spring"),
        one(name.endswith(".csproj"), "C# .NET"), one(name == "cmakelists.txt", "C++"), one(name == "cargo.toml", "Rust"),
    )
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    starts = F.when(name == "package.json", F.array_compact(F.array(F.get_json_object("__text", "$.main")))).otherwise(F.coalesce("__toml.bins", none))
    title = F.when(name == "package.json", F.get_json_object("__text", "$.name")).otherwise(F.col("__toml.name"))
    return held.select(
        "path", title.alias("name"), "dependencies", "frameworks", F.array_sort(F.array_distinct(types)).alias("project_types"),
        F.transform(starts, lambda x: F.concat(folder, F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^(\./)+", ""))).alias("entry_points"),
    )


def _node_dependencies(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{k}")), none) for k in ("dependencies", "devDependencies", "peerDependencies")])


def _requirements(text: Column, bare) -> Column:
    return F.filter(F.transform(X.lines(text), lambda x: bare(F.trim(x))), lambda x: (x != "") & ~x.startswith("#"))


VECTOR = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("payload", T.MapType(T.StringType(), T.StringType()))])


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of id, vector and payload; of an id that comes again the last line counts, by file and place."""
    rows = spark.read.schema(VECTOR).json(path).withColumn("__at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return rows.groupBy("id").agg(F.max_by(F.struct("vector", "payload"), "__at").alias("r")).select("id", "r.*")


def scroll(points: DataFrame, where: dict[str, str], limit: int, after=None, key: str = "id") -> DataFrame:
    """A page of points whose columns equal where, in order of key, behind the key after."""
    held = points if after is None else points.where(F.col(key) > after)
    for name, value in where.items():
        held = held.where(F.col(name).cast("string").eqNullSafe(F.lit(value)))
    return held.orderBy(key).limit(limit)


def resolved_ids(tried: DataFrame) -> DataFrame:
    """(name, id, errors) of candidates (name, id, pos, ok, error): the first that is ok, and the errors of the others in order."""
    errors = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("pos", "error")))), lambda x: x["error"]), "; ")
    first = F.min_by(F.when(F.col("ok"), F.col("id")), F.when(F.col("ok"), F.col("pos")))
    return tried.groupBy("name").agg(first.alias("id"), errors.alias("errors"))


def raw_dataset(spark: SparkSession, path: str) -> tuple[str, DataFrame | None]:
    """(loader, rows) of a raw folder: jsonl if it has raw.jsonl, splits if it has folders of Parquet (missing columns are null), parquet for files, or missing."""
    if not exists(spark, path):
        return "missing", None
    if exists(spark, f"{path}/raw.jsonl"):
        return "jsonl", spark.read.json(f"{path}/raw.jsonl")
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
    folders = sorted(x.getPath().toString() for x in listed if x.isDirectory() and not x.getPath().getName().startswith(("_", ".")))
    if folders:
        return "splits", splits(spark, folders)
    if any(x.getPath().getName().endswith(".parquet") for x in listed):
        return "parquet", spark.read.option("mergeSchema", "true").parquet(path)
    return "missing", None


def probe(df: DataFrame, n: int = 5) -> tuple[int, list[str], DataFrame]:
    """(rows, columns, the first n rows) of a raw table; rows are counted from footers where the format has them."""
    return df.count(), df.columns, df.limit(n)


def nth(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The row at place n of an ordered table: a filter, no sort."""
    return df.where(F.col(order) == n)


def statuses(wanted: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(name, status, n) of wanted (name) against found (name, n): missing, empty, small or ok."""
    held = wanted.join(found, "name", "left")
    n = F.coalesce("n", F.lit(0))
    return held.select("name", F.when(F.col("n").isNull(), "missing").when(n == 0, "empty").when(n < least, "small").otherwise("ok").alias("status"), n.alias("n"))
