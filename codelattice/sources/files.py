"""Source trees and tables of files: which files count, in which language, under which module, and which changed."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.scalar import module_path

# Directories that are left out, of every scan and of module scans.
SKIPPED = ("vendor", "testdata", "node_modules", ".git")
SKIPPED_MODULES = (
    "__pycache__", "venv", "env", ".venv", ".env", "node_modules", ".git", ".svn", "dist", "build", "_build", ".eggs", "*.egg-info", ".tox", ".pytest_cache", ".mypy_cache", ".coverage", "htmlcov", "tests", "test", "fixtures", "mocks", "migrations", "vendor",
    "third_party", "site-packages", "docs", "examples",
)


_SOURCE = re.compile(r"(?i)^dockerfile|docker-compose.*\.ya?ml$|\.(?:py|go|java)$|^go\.mod$")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """A file's language by its name first, its extension second; null for other files."""
    name = base_name(path)
    low = F.lower(name)
    return F.when(F.startswith(low, F.lit("dockerfile")), "dockerfile").when(low.rlike(r"docker-compose.*\.ya?ml$"), "compose").when(F.endswith(name, F.lit(".py")), "python").when(F.endswith(name, F.lit(".go")), "go").when(F.endswith(name, F.lit(".java")), "java")


def skipped(rel_path: Column, names: tuple[str, ...] = SKIPPED, underscored: bool = True) -> Column:
    """Whether a directory above the file is left out."""
    dirs = F.slice(F.split(rel_path, "/"), 1, F.greatest(F.size(F.split(rel_path, "/")) - 1, F.lit(0)))
    plain = [n for n in names if "*" not in n]
    return F.exists(dirs, lambda d: d.isin(*plain) | (F.startswith(d, F.lit("_")) if underscored else F.lit(False)) | (F.endswith(d, F.lit(".egg-info")) if "*.egg-info" in names else F.lit(False)))


_RAW = "path string, content binary"


def _walk(top: str, deep: bool) -> Iterator[str]:
    """Paths of the files below a directory, without directories that are left out; with ``deep`` false of the directory itself."""
    for here, dirs, names in os.walk(top):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and not d.startswith("_")) if deep else []
        yield from (os.path.join(here, n) for n in sorted(names))


def _read_tree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for top, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            paths: list[str] = []
            texts: list[bytes] = []
            for p in _walk(top, deep):
                if not _SOURCE.search(os.path.basename(p)):
                    continue
                with open(p, "rb") as f:
                    paths.append(p)
                    texts.append(f.read())
                if sum(map(len, texts)) > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], names=["path", "content"])
                    paths, texts = [], []
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], names=["path", "content"])


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``(file, rel_path, lang, content, sha256)`` of a source tree; bytes that aren't UTF-8 become replacement characters.

    A tree on a shared file system is walked by the tasks, two levels of directories being dealt out to them: Spark's own file source
    hides names that begin with an underscore, such as ``__init__.py``. Trees in object stores are read by that source.
    """
    if "://" in root and not root.startswith("file://"):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
        base = root.rstrip("/") + "/"
    else:
        top = os.path.abspath(root.removeprefix("file://"))
        base = top.rstrip("/") + "/"
        keep = lambda d: d.is_dir() and d.name not in SKIPPED and not d.name.startswith("_")
        work = [(top, False)]
        for one in sorted((d for d in os.scandir(top) if keep(d)), key=lambda d: d.name):
            below = sorted((d.path for d in os.scandir(one.path) if keep(d)))
            work += [(one.path, False), *((p, True) for p in below)]
        raw = spark.createDataFrame(work, "top string, deep boolean").repartition(max(1, min(len(work), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(_read_tree, _RAW)
    path = F.col("path")
    rel = F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)
    got = raw.select(path.alias("file"), rel.alias("rel_path"), language(path).alias("lang"), F.col("content").alias("_c"))
    return got.where(F.col("lang").isNotNull() & ~skipped(F.col("rel_path"))).select("file", "rel_path", "lang", F.make_valid_utf8(F.col("_c").cast("string")).alias("content"), F.sha2("_c", 256).alias("sha256"))


def table_files(source_files: DataFrame) -> DataFrame:
    """The same from a table (repo, file_path, source_code): one row a file, the one committed last; null code counts as empty."""
    newest = F.max_by(F.coalesce("source_code", F.lit("")), F.struct("committed_at", "source_code"))
    one = source_files.groupBy("repo", "file_path").agg(newest.alias("content"))
    lang = language(F.col("file_path"))
    return one.select(F.concat_ws("/", "repo", "file_path").alias("file"), F.col("file_path").alias("rel_path"), "repo", lang.alias("lang"), "content", F.sha2("content", 256).alias("sha256")).where(F.col("lang").isNotNull())


def is_test_file(path: Column) -> Column:
    name = base_name(path)
    return F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | name.isin("conftest.py", "setup.py", "__main__.py")


def scan_modules(files: DataFrame, skip_tests: bool = False) -> DataFrame:
    """``(module_path, file, short_name)`` of the Python files."""
    py = files.where((F.col("lang") == "python") & ~skipped(F.col("rel_path"), SKIPPED_MODULES, underscored=False))
    if skip_tests:
        py = py.where(~is_test_file(F.col("rel_path")))
    m = module_path(F.col("rel_path"))
    return py.select(m.alias("module_path"), "file", F.substring_index(m, ".", -1).alias("short_name")).where("module_path <> ''")


def scan_go_modules(files: DataFrame) -> DataFrame:
    """``(root, module, go_version)`` from go.mod files (rel_path, content)."""
    mods = files.where(base_name(F.col("rel_path")) == "go.mod")
    return mods.select(F.regexp_extract("rel_path", r"^(.*?)/?go\.mod$", 1).alias("root"), F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("module"), F.regexp_extract("content", r"(?m)^go\s+(\S+)", 1).alias("go_version"))


def go_packages(files: DataFrame, go_modules: DataFrame) -> DataFrame:
    """``(file, import_path)``: each Go file's directory below the nearest go.mod. Modules are few; each file brings its parents to them."""
    dirs = files.where("lang = 'go'").select("file", F.regexp_extract("rel_path", r"^(.*?)/?[^/]*$", 1).alias("_dir"))
    parts = F.split("_dir", "/")
    up = dirs.withColumn("root", F.explode(F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), "")))
    best = up.join(go_modules.select("root", "module"), "root").groupBy("file", "_dir").agg(F.max(F.struct(F.length("root").alias("n"), "root", "module")).alias("_m"))
    rest = F.regexp_replace(F.substring(F.col("_dir"), F.col("_m.n") + 1, F.length("_dir")), "^/", "")
    return best.select("file", F.when(rest == "", F.col("_m.module")).otherwise(F.concat_ws("/", "_m.module", rest)).alias("import_path"))


def changed_files(spark: SparkSession, repo: str, base: str, head: str = "HEAD") -> DataFrame:
    """``(path)`` of files added, copied, modified or renamed since the merge base of two revisions."""
    git = lambda *a: subprocess.run(["git", "-C", repo, *a], capture_output=True, text=True, check=True, timeout=60).stdout
    since = git("merge-base", base, head).strip()
    names = [n for n in git("diff", "--name-only", "--diff-filter=ACMR", since, head).splitlines() if n]
    return spark.createDataFrame([(n,) for n in names], "path string")
