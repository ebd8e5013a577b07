"""Registries of library types: methods of builtins, and modules read from registry records."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Return types of methods of builtin types.
BUILTIN_METHODS = {
    "builtins.str": {"builtins.str": "upper lower strip lstrip rstrip replace format join title capitalize center ljust rjust zfill casefold swapcase expandtabs removeprefix removesuffix translate", "builtins.list": "split rsplit splitlines", "builtins.bool": "startswith endswith isdigit isalpha isalnum isupper islower isspace isidentifier isnumeric", "builtins.int": "find rfind index rindex count", "builtins.bytes": "encode", "builtins.tuple": "partition rpartition"},
    "builtins.bytes": {"builtins.str": "decode hex", "builtins.bytes": "upper lower strip replace join", "builtins.list": "split", "builtins.bool": "startswith endswith", "builtins.int": "find count"},
    "builtins.list": {"None": "append extend insert remove clear sort reverse", "builtins.int": "index count", "builtins.list": "copy"},
    "builtins.dict": {"builtins.dict": "copy fromkeys", "dict_keys": "keys", "dict_values": "values", "dict_items": "items", "None": "update clear", "builtins.tuple": "popitem"},
    "builtins.set": {"builtins.set": "union intersection difference symmetric_difference copy", "None": "add remove discard clear update", "builtins.bool": "issubset issuperset isdisjoint"},
    "builtins.tuple": {"builtins.int": "index count"},
    "builtins.int": {"builtins.int": "bit_length bit_count", "builtins.bytes": "to_bytes"},
    "builtins.float": {"builtins.bool": "is_integer", "builtins.str": "hex"},
}


def builtin_registry(spark: SparkSession) -> DataFrame:
    """``(type_fqn, method, return_type, confidence)`` of builtin types."""
    rows = [(t, m, r, 1.0) for t, by in BUILTIN_METHODS.items() for r, names in by.items() for m in names.split()]
    return spark.createDataFrame(rows, "type_fqn string, method string, return_type string, confidence double")


def infer_literal(text: Column) -> Column:
    """The type of a literal by its text; null for other expressions."""
    s = F.trim(text)
    return (
        F.when(s.rlike(r"^(?:[rRuUfF]{0,2})(?:\".*\"|'.*')$"), "builtins.str").when(s.rlike(r"^[bB][rR]?(?:\".*\"|'.*')$"), "builtins.bytes").when(s.isin("True", "False"), "builtins.bool").when(s == "None", "None")
        .when(s.rlike(r"^[-+]?(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|\d[\d_]*)$"), "builtins.int").when(s.rlike(r"^[-+]?(?:\d[\d_]*\.\d*|\.\d+|\d+(?:\.\d*)?[eE][-+]?\d+)$"), "builtins.float")
        .when(s.rlike(r"^\[.*\]$"), "builtins.list").when(s.rlike(r"^\{\s*\}$|^\{[^{}]*:.*\}$"), "builtins.dict").when(s.rlike(r"^\{.*\}$"), "builtins.set").when(s.rlike(r"^\(.*,.*\)$|^\(\)$"), "builtins.tuple")
    )


def registry_functions(nodes: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """``(module, name, return_type, confidence)`` of the functions of registry records, from their flattened nodes."""
    attr = F.from_json("attributes", "return_type string, confidence double, signature string")
    f = nodes.where("schema_path = 'functions'").select("record_id", "name", attr.alias("_a"))
    return f.join(records.select("record_id", F.col(key).alias("module")).distinct(), "record_id").select("module", "name", F.coalesce("_a.return_type", "_a.signature").alias("return_type"), "_a.confidence").distinct()


def registry_mro(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``(class_fqn, ancestor, depth)`` of the classes of registry records that state theirs."""
    attr = F.from_json("attributes", "mro array<string>")
    c = nodes.where("schema_path = 'classes'").select("record_id", "name", attr["mro"].alias("mro"))
    named = c.join(records.select("record_id", F.col("module_name").alias("_m")).where("_m IS NOT NULL").distinct(), "record_id")
    return named.select(F.concat_ws(".", "_m", "name").alias("class_fqn"), F.posexplode("mro").alias("depth", "ancestor")).select("class_fqn", "ancestor", (F.col("depth") + 1).alias("depth")).distinct()


def scan_registry(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The records of a registry directory: ``(record_id, name, payload)`` of the files that its ``manifest.json`` lists and whose
    SHA-256 is the listed one, and ``(name, file, problem)`` for the others.

    The manifest lists ``modules`` (Python) or ``packages`` (Go): ``name`` or ``import_path``, ``file`` (without one a
    package's is its path with ``_`` for ``/``, and ``_stdlib.json``) and ``checksum`` (``sha256:…``; none is not checked). Executors read and check the files; only the list passes the driver.
    """
    base = root.rstrip("/")
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{base}/manifest.json", wholetext=True).collect()))
    listed = [(e.get("name") or e.get("import_path") or "", e.get("file") or (e.get("import_path") or "").replace("/", "_") + "_stdlib.json", (e.get("checksum") or "").removeprefix("sha256:").lower()) for e in [*(manifest.get("modules") or ()), *(manifest.get("packages") or ())]]
    want = spark.createDataFrame(listed, "name string, file string, checksum string")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(base).select("path", F.col("content").alias("_c"))
    rel = F.regexp_extract("path", re.escape(base.removeprefix("file://").removeprefix("file:")) + r"/(.*)$", 1)
    have = read.select(rel.alias("file"), F.sha2("_c", 256).alias("_sha"), F.make_valid_utf8(F.col("_c").cast("string")).alias("payload"))
    both = want.join(have, "file", "left").withColumn("problem", F.when(F.col("payload").isNull(), "missing").when((F.col("checksum") != "") & (F.col("checksum") != F.col("_sha")), "checksum"))
    return both.where("problem IS NULL").select(F.col("file").alias("record_id"), "name", "payload"), both.where("problem IS NOT NULL").select("name", "file", "problem")
