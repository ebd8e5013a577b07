"""Source files that do not parse: a flag for each file, what is wrong with it, and rates by repository and language.

Method: a file's text becomes tokens, the tokens units, and each unit goes through an error-correcting chart parser. The least
cost of repair is 0 exactly if the chart's first layer holds a derivation; a file any of whose units costs more is flagged. For
reports the chart is explored further, to the cheapest repair. Its edits have kinds and places, and those tell the cause:

    conflict        an edit falls on a line of a merge tool's marks
    truncated       every edit falls on the last line, or on the end of what was open there
    other_language  half of the file's units or more have edits
    other           anything else

Scale: files are independent; one pass without a shuffle. Units repeat across files and a unit's derivations depend on its tokens
alone, so each worker keeps them in tables of bounded size, which makes the chart parser's cost that of the distinct units.

Defined results
    * Null and empty source code is no case. Files whose name stands for none of the languages are left out.
    * The text is taken whole; letter case of ``Dockerfile`` doesn't matter; the ``lang`` column isn't used.
    * Nesting beyond the parser's depth is a fault.
    * Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.syntax import dockerfile, golang, java, python3, yamlfile
from codelattice.llm.syntax.chart import Edit, Grammar
from codelattice.llm.syntax.tree import Fault, Outline, least_repair

_NAMES = (("python", r"\.py$"), ("go", r"\.go$"), ("java", r"\.java$"), ("dockerfile", r"(?i)^dockerfile[^/]*$"), ("compose", r"(?i)docker-compose[^/]*\.ya?ml$"))
_NAMES = tuple((lang, re.compile(p)) for lang, p in _NAMES)
_OUTLINES = {"python": python3.outline, "go": golang.outline, "java": java.outline, "dockerfile": dockerfile.outline, "compose": yamlfile.outline}
_MARKER = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?: .*)?\r?$", re.M)


def language_of(path: str | None) -> str | None:
    """The language that a file's name stands for."""
    name = (path or "").rpartition("/")[2]
    return next((lang for lang, p in _NAMES if p.search(name)), None)


def outline_of(language: str, text: str) -> Outline:
    try:
        return _OUTLINES[language](text)
    except RecursionError:
        return Outline([Fault(0, len(text), "depth")], 1)


def is_invalid(language: str, text: str, outline: Outline | None = None) -> bool:
    """Whether the least cost of repair is above 0."""
    got = outline or outline_of(language, text)
    return bool(got.faults)


def _grammar(language: str, fault):
    if language in ("go", "java"):
        module = golang if language == "go" else java
        return module.GRAMMAR if fault.symbol != "file" else module._FILES
    return {"python": python3, "dockerfile": dockerfile, "compose": yamlfile}[language].grammar_of(fault)


@lru_cache(maxsize=20_000)
def _repair(grammar: Grammar, symbol: str, tokens: tuple[str, ...]) -> tuple[int, list[Edit]]:
    """The cheapest repair, which depends on the tokens alone."""
    return least_repair(grammar, Fault(0, 0, symbol, tokens))


def edits_of(language: str, text: str, fault: Fault) -> tuple[int, list[tuple[int, bool]]]:
    """A faulty unit's least cost of repair and its edits: the offset of each, and whether it falls on the end of the text."""
    size = len(text.rstrip())
    last_line = text.rfind("\n", 0, size) + 1 or size  # a text of one line has no last one
    reaches = fault.end >= size
    grammar = _grammar(language, fault) if fault.tokens else None
    if grammar is None or not grammar.has(fault.symbol):  # a bracket, an indentation or a scalar
        where = min(fault.end, size) if fault.symbol == "unclosed" or fault.symbol == "scalar" and reaches else fault.start
        return 1, [(where, where >= last_line)]
    cost, edits = _repair(grammar, fault.symbol, fault.tokens)
    size_of = len(fault.tokens)
    if reaches and grammar.derives(fault.tokens, fault.symbol)[1] >= size_of:  # all of it begins a derivation: the rest is missing
        return max(1, cost), [(size, True)]
    out = []
    for e in edits:
        last = e.at >= size_of - 1
        where = fault.offsets[e.at] if e.at < len(fault.offsets) else fault.end if last else fault.start
        out.append((where, where >= last_line or last and reaches))
    return max(1, cost), out or [(fault.start, False)]


def diagnose(language: str, text: str, outline: Outline) -> tuple[str, int, int]:
    """The cause (``conflict``, ``truncated``, ``other_language`` or ``other``), the cost summed over the units, and the first edit's line."""
    cost, edits, faulty = 0, [], set()
    for fault in outline.faults:
        c, some = edits_of(language, text, fault)
        cost += c
        edits += some
        faulty.add(fault.start)
    first = min(where for where, _ in edits)
    if any(_MARKER.match(text, text.rfind("\n", 0, where) + 1) for where, _ in edits):
        cause = "conflict"
    elif all(at_end for _, at_end in edits):
        cause = "truncated"
    elif 2 * len(faulty) >= outline.units and (len(faulty) > 1 or outline.units == 1):
        cause = "other_language"
    else:
        cause = "other"
    return cause, cost, text.count("\n", 0, first) + 1


def _flags(details: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, langs, flags, causes, costs, lines = [], [], [], [], [], []
            for i, (path, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                lang = language_of(path)
                if lang is None:
                    continue
                got = outline_of(lang, text)
                bad = is_invalid(lang, text, got)
                if not details and not bad:
                    continue
                keep.append(i)
                langs.append(lang)
                flags.append(bad)
                if details:
                    cause, cost, line = diagnose(lang, text, got) if bad else (None, 0, None)
                    causes.append(cause)
                    costs.append(cost)
                    lines.append(line)
            columns = [b.column(0).take(pa.array(keep, pa.int32())), pa.array(langs, pa.string()), pa.array(flags, pa.bool_())]
            names = ["id", "language", "invalid"]
            if details:
                columns += [pa.array(causes, pa.string()), pa.array(costs, pa.int32()), pa.array(lines, pa.int32())]
                names += ["cause", "cost", "line"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def check_files(files: DataFrame, id_col: str, path_col: str, text_col: str, details: bool = False) -> DataFrame:
    """``(id_col, language, invalid)`` for the invalid files; with ``details`` for all files, with cause, cost and line."""
    got = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").alias("path"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL AND text <> ''")
    schema = f"id {files.schema[id_col].dataType.simpleString()}, language string, invalid boolean" + ", cause string, cost int, line int" * details
    return got.mapInArrow(_flags(details), schema).distinct().withColumnRenamed("id", id_col)


def invalid_rates(files: DataFrame, id_col: str, path_col: str, text_col: str, repo_col: str) -> DataFrame:
    """Files, invalid files and their share per repository and language; counts are added up before the shuffle."""
    checked = check_files(files, id_col, path_col, text_col, details=True)
    repos = files.select(id_col, F.col(f"`{repo_col}`").alias("repo")).distinct()
    one = checked.groupBy(id_col, "language").agg(F.max("invalid").alias("invalid"), F.max("cause").alias("cause"))
    by = one.join(repos, id_col).groupBy("repo", "language")
    causes = [F.count_if(F.col("cause") == c).alias(c) for c in ("truncated", "conflict", "other_language", "other")]
    return by.agg(F.count("*").alias("files"), F.count_if("invalid").alias("invalid_files"), *causes).withColumn("rate", F.round(F.col("invalid_files") / F.col("files"), 6))
