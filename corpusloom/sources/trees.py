"""Source trees as a PySpark data source ("source_tree"), for reading and for writing.

Reading: folders are listed level by level, hidden ones too, and excluded ones are not entered. What names and sizes
say about a file is decided then, so a file that is passed over is never opened; the others are dealt to
partitions by their sizes. A prefix of the paths keeps other folders from being listed. Writing: a file per row.

Options stand in for pushed predicates: Spark keeps what a predicate left of the partitions with the loaded frame, so a
frame that is used twice in a query, once with a predicate, would lose rows in the other use.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import code as C
from ..operators import rules
from ..session import python_path

# Fixed values
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "dist", "build", "out", "target", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox",
    ".cache", "cache", "caches", ".parcel-cache", ".next", ".nuxt", "coverage", "logs", "log", "qdrant_storage", "models",
)
EXCLUDED_SUFFIXES = (
    ".arrow", ".bin", ".ckpt", ".crt", ".db", ".dll", ".dylib", ".exe", ".gif", ".gz", ".ico", ".ipynb", ".jar", ".jpeg", ".jpg", ".key", ".log", ".mp4", ".onnx", ".parquet", ".pem", ".pdf",
    ".png", ".pt", ".pth", ".pyc", ".pyd", ".so", ".safetensors", ".sqlite", ".tar", ".tmp", ".zip",
)
SECRET_NAMES = (".env", ".env.local", ".env.development", ".env.production", ".env.test", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")
SECRET_SUFFIXES = (".pem", ".key", ".crt")
MAX_BYTES, SNIFF, TEXT_SHARE = 1_000_000, 4096, 0.75

SCHEMA = "path string, kind string, length long, skip string, sha256 string, content string"
#: Bytes and files of a partition; what opening a file costs, in bytes; bytes of an Arrow batch; folders that are listed at once.
SPLIT_BYTES, SPLIT_FILES, OPEN_BYTES, BATCH_BYTES, LISTERS = 64 << 20, 4096, 64 << 10, 8 << 20, 16


def files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


@dataclass
class Entry:
    """path: below the root, as the file system has it. length: None where it can't be told."""

    path: str
    folder: bool
    length: int | None


@dataclass
class Part(InputPartition):
    told: list[tuple[str, str, int | None, str]]
    opened: list[tuple[str, int]]


def _listed(system: pafs.FileSystem, top: str, folder: str) -> list[Entry]:
    """What is right in a folder. Links to folders are neither entered nor listed; what can't be listed is empty."""
    whole = posixpath.join(top, folder) if folder else top
    found = []
    if isinstance(system, pafs.LocalFileSystem):
        try:
            with os.scandir(whole) as entries:
                for e in entries:
                    name = posixpath.join(folder, e.name)
                    if e.is_dir():
                        if not e.is_symlink():
                            found.append(Entry(name, True, None))
                        continue
                    try:
                        found.append(Entry(name, False, e.stat().st_size))
                    except OSError:
                        found.append(Entry(name, False, None))
        except OSError:
            if not folder:
                raise
        return found
    for info in system.get_file_info(pafs.FileSelector(whole, recursive=False)):
        name = posixpath.join(folder, posixpath.basename(info.path.rstrip("/")))
        found.append(Entry(name, info.type == pafs.FileType.Directory, info.size if info.type == pafs.FileType.File else None))
    return found


def name_reason(path: str, length: int | None) -> str | None:
    """What a file's name and size say against it: secret, unsupported_type, stat_failed, too_large; or None."""
    name = posixpath.basename(path).lower()
    stem, dot, end = name.rpartition(".")
    suffix = dot + end if stem and end else ""
    if name in SECRET_NAMES or (name.startswith(".env") and name != ".env.example") or suffix in SECRET_SUFFIXES:
        return "secret"
    if suffix in EXCLUDED_SUFFIXES or not (name in C.BY_NAME or suffix in C.BY_SUFFIX):
        return "unsupported_type"
    if length is None:
        return "stat_failed"
    return "too_large" if length > MAX_BYTES else None


_TEXT = bytes(b for b in range(256) if b in (9, 10, 13) or 32 <= b <= 126 or b >= 128)


def binary(data: bytes) -> bool:
    """A NUL, or under three quarters text bytes, in the first bytes."""
    sample = data[:SNIFF]
    return b"\0" in sample or len(sample) - len(sample.translate(None, _TEXT)) < TEXT_SHARE * len(sample)


def _text(data: bytes) -> str:
    """data as text, without what isn't UTF-8; each line end is a newline."""
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def _shown(path: str) -> str:
    """path as a string column can hold it."""
    return os.fsencode(path).decode("utf-8", "replace")


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.contents = options.get("contents", "true") == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.prefix, self.kept = options.get("prefix", ""), options.get("kept", "false") == "true"

    def _entered(self, folder: str) -> bool:
        """Whether a folder can hold a path with the prefix."""
        inside = _shown(folder) + "/"
        return inside.startswith(self.prefix) or self.prefix.startswith(inside)

    def partitions(self) -> list[Part]:
        system, top = files(self.path)
        told, plain, level = [], [], [""]
        with ThreadPoolExecutor(LISTERS) as pool:
            while level:
                found = [e for entries in pool.map(lambda f: _listed(system, top, f), level) for e in entries]
                level = []
                for e in found:
                    if e.folder:
                        if posixpath.basename(e.path) in EXCLUDED_DIRS:
                            if _shown(e.path).startswith(self.prefix):
                                told.append((e.path, "folder", None, "excluded"))
                        elif self._entered(e.path):
                            level.append(e.path)
                    elif _shown(e.path).startswith(self.prefix):
                        reason = name_reason(e.path, e.length)
                        if reason:
                            told.append((e.path, "file", e.length, reason))
                        else:
                            plain.append((e.path, e.length))
        if self.kept:
            told = []
        parts, size = [Part(told[i : i + 65536], []) for i in range(0, len(told), 65536)], 0
        for path, length in sorted(plain):
            if not size or size + length + OPEN_BYTES > self.split_bytes or len(parts[-1].opened) >= SPLIT_FILES:
                parts.append(Part([], []))
                size = 0
            parts[-1].opened.append((path, length))
            size += length + OPEN_BYTES
        return parts or [Part([], [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("skip", pa.string()), ("sha256", pa.string()), ("content", pa.string())])
        rows = [(_shown(path), kind, length, reason, None, None) for path, kind, length, reason in part.told]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        system, top = files(self.path) if part.opened else (None, "")
        rows, size = [], 0
        for path, length in part.opened:
            try:
                with system.open_input_stream(posixpath.join(top, path), compression=None) as stream:
                    data = stream.read(SNIFF)
                    skip = "binary" if binary(data) else None
                    data += stream.read(MAX_BYTES + 1) if skip is None and self.contents else b""
            except OSError:
                data, skip = b"", "binary"
            good = skip is None and self.contents
            rows.append((_shown(path), "file", length, skip, hashlib.sha256(data).hexdigest() if good else None, _text(data) if good else None))
            size += len(data) + 200
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


class TreeWriter(DataSourceArrowWriter):
    """Takes columns path and content. A file is written beside its place and renamed, so a task that runs again leaves whole files."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, top = files(self.path)
        made = set()
        for batch in iterator:
            paths, contents = (batch.column(batch.schema.get_field_index(c)) for c in ("path", "content"))
            for path, content in zip(paths, contents):
                whole = posixpath.normpath(posixpath.join(top, path.as_py()))
                if not whole.startswith(posixpath.normpath(top) + "/"):
                    raise ValueError(f"{path.as_py()} is not below the root")
                folder, name = posixpath.split(whole)
                if folder not in made:
                    system.create_dir(folder)
                    made.add(folder)
                data = content.as_py() or b""
                new = f"{folder}/.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(new, compression=None) as out:
                    out.write(data.encode() if isinstance(data, str) else data)
                system.move(new, whole)
        return WriterCommitMessage()


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options)


def scan(spark: SparkSession, root: str, contents: bool = True, prefix: str = "", kept: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All files below root and the folders that were left out: path (relative), kind (file or folder), length, skip, sha256, content.

    skip is why a file isn't indexed: secret, unsupported_type, stat_failed, too_large or binary (what can't be read
    counts as that); of a folder it is excluded. Only files without a reason have a digest (of their bytes) and content (as text, line
    ends as newlines, without what isn't UTF-8); those that names or sizes speak against are never opened. Without contents
    only the first bytes of a file are read, and there is no digest. prefix: paths that begin otherwise aren't listed. kept: without what is skipped.
    The driver holds a path and a size per file; a folder that can't be listed is empty.
    """
    python_path(spark)
    spark.dataSource.register(SourceTree)
    options = {"contents": str(contents).lower(), "prefix": prefix, "kept": str(kept).lower(), "split_bytes": str(split_bytes)}
    found = spark.read.format("source_tree").options(**options).load(root)
    return found.where("skip IS NULL") if kept else found


def write(df: DataFrame, root: str) -> None:
    """A file below root for each row (path, content: text or bytes; null is empty). Of rows with one path any stays."""
    python_path(df.sparkSession)
    df.sparkSession.dataSource.register(SourceTree)
    df.select("path", "content").write.format("source_tree").mode("append").save(root)


def texts(found: DataFrame) -> DataFrame:
    """path, length, sha256, skip, language, content of the files of a scan; what is indexed has a language."""
    return found.where("kind = 'file'").select("path", "length", "sha256", "skip", F.when(F.col("skip").isNull(), C.language("path", "content")).alias("language"), "content")


def first_files(spark: SparkSession, root: str, most: int) -> DataFrame:
    """scan(), up to the indexed file of that number, by path; a tree with fewer is whole."""
    plain = scan(spark, root, contents=False, kept=True)
    last = plain.select("path").orderBy("path").limit(most).agg(F.max("path").alias("__last"), F.count("*").alias("__n"))
    return scan(spark, root).join(F.broadcast(last), (F.col("__n") < most) | (F.col("path") <= F.col("__last"))).drop("__last", "__n")


def statistics(found: DataFrame) -> DataFrame:
    """(what, name, n) of a scan: files by reason, folders that were left out, indexed files by language."""
    names = F.when(F.col("kind") == "folder", F.struct(F.lit("folder").alias("what"), F.col("path").alias("name"))).when(F.col("skip").isNotNull(), F.struct(F.lit("skipped").alias("what"), F.col("skip").alias("name")))
    named = names.otherwise(F.struct(F.lit("language").alias("what"), C.language("path", F.lit("")).alias("name")))
    return rules.counts(found.select(named.alias("s")).select("s.*"), "what", "name")
