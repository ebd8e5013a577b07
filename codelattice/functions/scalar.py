"""Scalar functions on names, paths, container fields and findings, as Spark columns. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in order, and the scores and levels that exports give them.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCORE = {"critical": "9.0", "high": "7.0", "medium": "5.0", "low": "3.0"}
# Kinds of symbols by node type, as editors number them.
SYMBOL_KINDS = {
    "function_definition": 12, "function_declaration": 12, "init_function": 12, "func_literal": 12, "method": 6, "method_declaration": 6, "special_method": 6, "constructor": 9, "property": 7,
    "class_definition": 5, "class_declaration": 5, "dataclass": 5, "struct_definition": 23, "interface": 11, "enum": 10, "type_alias": 26, "module_variable": 13, "package_variable": 13,
    "variable_assignment": 13, "variable_declaration": 13, "parameter": 13, "constant": 14, "class_field": 8, "dockerfile_instruction": 15, "compose_service": 2,
}
# Confidence by how a type became known.
CONFIDENCE = {"annotation": 1.0, "literal": 0.95, "constructor": 0.95, "return": 0.9, "assignment": 0.85, "attribute": 0.8, "fluent": 0.7}


def _case(value: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(default)


def short_name(fqn: Column) -> Column:
    """The last dotted segment."""
    return F.substring_index(fqn, ".", -1)


def module_of(fqn: Column) -> Column:
    """What stands before the last dot; '' for names without one."""
    return F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)


def strip_parens(call: Column) -> Column:
    """A call's text up to its first bracket."""
    return F.substring_index(call, "(", 1)


def module_path(rel_path: Column) -> Column:
    """The dotted module of a Python file: without ``.py`` and ``__init__``."""
    plain = F.regexp_replace(F.regexp_replace(rel_path, r"^/+", ""), r"\.py$", "")
    return F.regexp_replace(F.translate(plain, "/", "."), r"(^|\.)__init__$", "")


def rel_path(path: Column, root: str) -> Column:
    """A path below ``root`` without it; other paths as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def sha256_id(*parts: Column) -> Column:
    """A symbol's id: the SHA-256 of its parts, joined by dashes; nulls count as empty."""
    return F.sha2(F.concat_ws("-", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def is_constant_name(name: Column) -> Column:
    return name.rlike(r"^[A-Z0-9_]*[A-Z][A-Z0-9_]*$")


def is_pascal_case(name: Column) -> Column:
    """A capital first, a lower-case letter somewhere, no underscore."""
    return name.rlike(r"^[A-Z][A-Za-z0-9]*$") & name.rlike(r"[a-z]")


def visibility(name: Column, language: Column) -> Column:
    """``public`` or ``private`` by naming: a leading capital in Go, a leading underscore in Python."""
    go = F.when(name.rlike(r"^[A-Z]"), "public").otherwise("private")
    return F.when(language == "go", go).when(name.rlike(r"^_"), "private").otherwise("public")


def strip_type_wrappers(kind: Column) -> Column:
    """``Optional[X]``, ``X | None``, quotes and pointers around a type name removed."""
    s = F.regexp_replace(F.trim(kind), r"^[\"']|[\"']$", "")
    s = F.regexp_replace(s, r"^(?:typing\.)?(?:Optional|Final|ClassVar|Annotated|Type)\[(.*)\]$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*\|\s*None\b|\bNone\s*\|\s*", ""), r"^[*&]+", ""))


def normalize_return_type(kind: Column) -> Column:
    """Bare builtin types get their module."""
    return F.when(kind.isin("str", "int", "float", "bool", "list", "dict", "set", "tuple", "bytes"), F.concat(F.lit("builtins."), kind)).otherwise(kind)


def go_module_name(fqn: Column) -> Column:
    """The import path of a Go name: up to the first dot behind the last slash."""
    return F.regexp_extract(fqn, r"^((?:[^/]*/)*[^./]*)", 1)


def is_go_stdlib(fqn: Column) -> Column:
    """Whether the first element of an import path has no dot, as in Go's standard library."""
    return ~F.contains(F.substring_index(fqn, "/", 1), F.lit(".")) | (~F.contains(fqn, F.lit("/")) & fqn.rlike(r"^[a-z][a-z0-9]*\."))


def clamp(confidence: Column) -> Column:
    """Within 0 and 1; not-a-number and null are 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(confidence.cast("double"), F.lit(0.0)), F.lit(0.0))))


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def normalize_severity(severity: Column) -> Column:
    """Lower case; unknown and null severities are medium."""
    s = F.lower(F.trim(severity))
    return F.when(s.isin(*SEVERITIES), s).otherwise("medium")


def severity_rank(severity: Column) -> Column:
    return _case(severity, {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def detection_type(scope: Column) -> Column:
    """``pattern`` without a scope, ``taint-local`` for local, ``taint-global`` for any other."""
    s = F.coalesce(scope, F.lit(""))
    return F.when(s == "", "pattern").when(s == "local", "taint-local").otherwise("taint-global")


def cwe_url(cwe: Column) -> Column:
    n = F.regexp_extract(cwe, r"(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), n, F.lit(".html"))).otherwise("")


def symbol_kind(node_type: Column) -> Column:
    return _case(node_type, SYMBOL_KINDS, 13)


def image_parts(image: Column) -> Column:
    """``struct<name, tag, digest>``: cut at the first ``@``, else at the last ``:`` behind the last ``/``; neither gives tag ``latest``."""
    has_digest = F.contains(image, F.lit("@"))
    name = F.when(has_digest, F.substring_index(image, "@", 1)).otherwise(F.regexp_replace(image, r":[^:/]*$", ""))
    tag = F.when(has_digest, "").otherwise(F.regexp_extract(image, r":([^:/]*)$", 1))
    digest = F.when(has_digest, F.regexp_extract(image, r"@(.*)$", 1)).otherwise("")
    return F.struct(name.alias("name"), F.when((tag == "") & (digest == ""), "latest").otherwise(tag).alias("tag"), digest.alias("digest"))


def user_parts(user: Column) -> Column:
    return F.struct(F.substring_index(user, ":", 1).alias("user"), F.when(F.contains(user, F.lit(":")), F.regexp_extract(user, r":(.*)$", 1)).otherwise("").alias("group"))


def port_parts(port: Column) -> Column:
    """``80/udp`` as ``struct<port, protocol>``; tcp where none is given."""
    proto = F.lower(F.regexp_extract(port, r"/(\w+)$", 1))
    return F.struct(F.try_to_number(F.regexp_extract(port, r"^(\d{1,9})", 1), F.lit("999999999")).cast("int").alias("port"), F.when(proto == "", "tcp").otherwise(proto).alias("protocol"))


def combine_confidence(values: Column) -> Column:
    """The product over an array."""
    return F.aggregate(values, F.lit(1.0), lambda a, b: a * b)
