"""Dockerfile and compose rules, and facts about container files.

Instructions: file, line, seq, instruction, raw, image, tag, digest, alias, user_name, group_name, ports, protocol, arg_name, env,
labels, flags, copy_from, workdir, command_form, volumes. Compose properties: repo, file_path, service, service_line, prop_key,
kind, scalar, scalar_type, prop_items, line (maps as ``key=value`` items).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from codelattice.operators.matching import all_of, any_of


def docker_instruction(
    instructions: DataFrame, kind: str, image_tag: str | None = None, base_image: str | None = None, user_name: str | None = None, arg_name_regex: str | None = None, contains: str | None = None,
    not_contains: str | None = None, port_less_than: int | None = None, port_greater_than: int | None = None, missing_digest: bool = False, strict: dict | None = None,
) -> DataFrame:
    """Instructions of a kind that meet all criteria. Ports: any one. Further authoring arguments are no-ops unless given in ``strict``."""
    tests = [F.upper(F.col("instruction")) == kind.upper()]
    if image_tag is not None:
        tests.append(F.col("tag") == image_tag)
    if base_image is not None:
        tests.append(F.col("image") == base_image)
    if user_name is not None:
        tests.append(F.col("user_name") == user_name)
    if arg_name_regex is not None:
        tests.append(F.col("arg_name").rlike(arg_name_regex))
    if contains is not None:
        tests.append(F.contains(F.col("raw"), F.lit(contains)))
    if not_contains is not None:
        tests.append(~F.contains(F.col("raw"), F.lit(not_contains)))
    if port_less_than is not None:
        tests.append(F.exists("ports", lambda p: p < port_less_than))
    if port_greater_than is not None:
        tests.append(F.exists("ports", lambda p: p > port_greater_than))
    if missing_digest:
        tests.append(F.coalesce(F.col("digest"), F.lit("")) == "")
    tests += [_strict(k, v) for k, v in (strict or {}).items()]
    return instructions.where(F.coalesce(all_of(tests), F.lit(False)))


def _strict(name: str, value) -> Column:
    """Criteria that rules may state and that only strict evaluation reads."""
    c = F.col
    table = {
        "image_tag_regex": lambda: c("tag").rlike(value), "user_name_regex": lambda: c("user_name").rlike(value), "port": lambda: F.array_contains("ports", value), "protocol": lambda: c("protocol") == value, "arg_name": lambda: c("arg_name") == value,
        "copy_from": lambda: c("copy_from") == value, "missing_flag": lambda: ~F.map_contains_key("flags", value), "label_key": lambda: F.map_contains_key("labels", value), "command_form": lambda: c("command_form") == value,
        "workdir_not_absolute": lambda: ~F.startswith(c("workdir"), F.lit("/")) if value else F.lit(True), "regex": lambda: c("raw").rlike(value), "not_regex": lambda: ~c("raw").rlike(value),
    }
    if name not in table:
        raise ValueError(f"no strict criterion {name!r}")
    return table[name]()


def docker_missing(files: DataFrame, instructions: DataFrame, kind: str) -> DataFrame:
    """``(file, line)``: files without an instruction of the kind, at line 1."""
    have = instructions.where(F.upper(F.col("instruction")) == kind.upper()).select("file").distinct()
    return files.select("file").distinct().join(have, "file", "left_anti").withColumn("line", F.lit(1))


def compose_has(props: DataFrame, key: str, equals=None, contains: str | None = None, contains_any: Sequence[str] = ()) -> DataFrame:
    """Services whose property equals a value, holds a text (or any list item does), or has any of some items."""
    typed = {bool: "bool", int: "int", float: "float", str: "str"}
    tests = []
    if equals is not None:
        text = str(equals).lower() if isinstance(equals, bool) else str(equals)
        value = F.lower("scalar") if isinstance(equals, bool) else F.col("scalar")
        tests.append((value == text) & (F.col("scalar_type").isNull() | F.col("scalar_type").isin(typed[type(equals)], {"str": "string", "int": "integer", "bool": "boolean", "float": "double"}[typed[type(equals)]])))
    if contains is not None:
        tests.append(F.contains(F.col("scalar"), F.lit(contains)) | F.exists("prop_items", lambda x: F.contains(x, F.lit(contains))))
    if contains_any:
        tests.append(F.exists("prop_items", lambda x: any_of([x == v for v in contains_any])))
    return props.where((F.col("prop_key") == key) & F.coalesce(any_of([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)))


def compose_missing(props: DataFrame, key: str) -> DataFrame:
    """``(repo, file_path, service, line)``: services without the property, at the line of the service."""
    services = props.groupBy("repo", "file_path", "service").agg(F.min("service_line").alias("line"), F.max(F.when(F.col("prop_key") == key, 1).otherwise(0)).alias("_has"))
    return services.where("_has = 0").drop("_has")


def docker_final_user(instructions: DataFrame) -> DataFrame:
    """``(file, final_user, runs_as_root)``: the last USER of each file; none, root or 0 runs as root."""
    u = F.when(F.col("instruction") == "USER", F.struct("line", "seq", "user_name"))
    last = instructions.groupBy("file").agg(F.max(u).alias("_u")).select("file", F.coalesce("_u.user_name", F.lit("")).alias("final_user"))
    return last.withColumn("runs_as_root", F.col("final_user").isin("", "root", "0"))


def docker_stages(instructions: DataFrame) -> DataFrame:
    """``(file, stage_index, alias, image, start_line, end_line, is_final)``: stages from one FROM to the next."""
    per_file = instructions.groupBy("file").agg(F.max("line").alias("_last"))
    w = Window.partitionBy("file").orderBy("line", "seq")
    froms = instructions.where("instruction = 'FROM'").withColumns({"stage_index": F.row_number().over(w) - 1, "_next": F.lead("line").over(w)})
    return froms.join(per_file, "file").select("file", "stage_index", "alias", "image", F.col("line").alias("start_line"), F.coalesce(F.col("_next") - 1, F.col("_last")).alias("end_line"), F.col("_next").isNull().alias("is_final"))


def dockerfile_details(instructions: DataFrame) -> DataFrame:
    """One row a file: base image, stages, whether it has a user, health check, entry point and so on."""
    has = lambda k: F.max(F.when(F.col("instruction") == k, True).otherwise(False)).alias(f"has_{k.lower()}")
    first = F.min_by(F.col("image"), F.when(F.col("instruction") == "FROM", F.col("line"))).alias("base_image")
    named = F.count_if((F.col("instruction") == "FROM") & (F.coalesce("alias", F.lit("")) != ""))
    return instructions.groupBy("file").agg(first, F.count("*").alias("instructions"), F.count_if(F.col("instruction") == "FROM").alias("stages"), (named > 0).alias("multi_stage"), *(has(k) for k in ("USER", "HEALTHCHECK", "ENTRYPOINT", "CMD", "EXPOSE", "WORKDIR")))


def port_in_items(items: Column, port: int) -> Column:
    """Whether a list of ``host:container/protocol`` items exposes a port."""
    return F.exists(items, lambda p: F.regexp_extract(F.substring_index(p, ":", -1), r"^(\d+)", 1) == str(port))


def compose_facts(props: DataFrame) -> DataFrame:
    """One row a service: privileged, docker socket, host network, capabilities, read-only root, security options."""
    is_ = lambda k: F.col("prop_key") == k
    true = F.lower("scalar").isin("true", "yes", "1")
    any_item = lambda k, f: F.coalesce(F.bool_or(is_(k) & F.exists("prop_items", f)), F.lit(False))
    return props.groupBy("repo", "file_path", "service").agg(
        F.coalesce(F.bool_or(is_("privileged") & true), F.lit(False)).alias("privileged"), any_item("volumes", lambda v: F.contains(v, F.lit("docker.sock"))).alias("docker_socket"),
        F.coalesce(F.bool_or(is_("network_mode") & (F.col("scalar") == "host")), F.lit(False)).alias("host_network"), (~F.coalesce(F.bool_or(is_("read_only") & true), F.lit(False))).alias("writable_root"),
        F.coalesce(F.bool_or(is_("cap_add")), F.lit(False)).alias("adds_capabilities"), F.coalesce(F.bool_or(is_("security_opt")), F.lit(False)).alias("has_security_opt"), F.count_if(is_("ports")).alias("port_lists"),
    )


def compose_environment(props: DataFrame) -> DataFrame:
    """``(repo, file_path, service, name, value)``: environment variables in map or list form."""
    e = props.where(F.col("prop_key") == "environment").withColumn("_e", F.explode("prop_items"))
    return e.select("repo", "file_path", "service", F.regexp_extract("_e", r"^([^=]+)", 1).alias("name"), F.regexp_extract("_e", r"^[^=]+=(.*)$", 1).alias("value"))


class Dockerfile:
    """One file's instructions, as custom checks see them: dicts in their order."""

    def __init__(self, instructions: Sequence[Mapping[str, Any]]) -> None:
        self.instructions = list(instructions)

    def get_instructions(self, instruction: str) -> list[Mapping[str, Any]]:
        return [i for i in self.instructions if i["instruction"] == instruction.upper()]

    def has_instruction(self, instruction: str) -> bool:
        return bool(self.get_instructions(instruction))

    def get_stages(self) -> list[list[Mapping[str, Any]]]:
        """The instructions of each build stage; a stage begins at its FROM."""
        out: list[list[Mapping[str, Any]]] = []
        for i in self.instructions:
            if i["instruction"] == "FROM":
                out.append([])
            if out:
                out[-1].append(i)
        return out

    def is_multi_stage(self) -> bool:
        return len(self.get_stages()) > 1

    def get_stage_by_alias(self, alias: str) -> list[Mapping[str, Any]] | None:
        return next((s for s in self.get_stages() if s[0].get("alias") == alias), None)

    def get_final_user(self) -> Mapping[str, Any] | None:
        users = self.get_instructions("USER")
        return users[-1] if users else None

    def is_running_as_root(self) -> bool:
        user = self.get_final_user()
        return user is None or user.get("user_name") in ("", "root", "0", None)


def docker_custom(instructions: DataFrame, check: Callable[[Dockerfile], Any], description: str = "") -> DataFrame:
    """``(file, line, detail)`` of the files for which the check is true; the line is that of the first instruction.

    A file's instructions are bounded by its size, so one array a file travels to the check.
    """
    cols = [c for c in instructions.columns if c != "file"]
    files = instructions.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", *(c for c in cols if c != "seq" and not isinstance(instructions.schema[c].dataType, MapType))))).alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(f, rows[0]["line"]) for f, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if check(Dockerfile(rows))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in hits], pa.string()), pa.array([n for _, n in hits], pa.int32()), pa.array([description] * len(hits), pa.string())], names=["file", "line", "detail"])

    return files.mapInArrow(run, "file string, line int, detail string")
