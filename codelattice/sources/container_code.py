"""Dockerfiles to typed instructions and compose files to properties, one pass over the files each."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The instructions that are read.
INSTRUCTIONS = frozenset("FROM RUN CMD LABEL MAINTAINER EXPOSE ENV ADD COPY ENTRYPOINT VOLUME USER WORKDIR ARG ONBUILD STOPSIGNAL HEALTHCHECK SHELL".split())
_PAIR = re.compile(r"""([^\s=]+)=("(?:[^"\\]|\\.)*"|'[^']*'|(?:[^\s\\]|\\.)*)""")

DOCKER = (
    "file string, line int, seq int, instruction string, raw string, image string, tag string, digest string, alias string, user_name string, group_name string, ports array<int>, protocol string, arg_name string, "
    "env map<string,string>, labels map<string,string>, flags map<string,string>, copy_from string, workdir string, command_form string, volumes array<string>"
)
COMPOSE = "file string, service string, service_line int, prop_key string, kind string, scalar string, scalar_type string, prop_items array<string>, line int"


def _pairs(rest: str) -> dict[str, str]:
    got = {k: v[1:-1] if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1 else v for k, v in _PAIR.findall(rest)}
    if not got and rest.strip():
        k, _, v = rest.strip().partition(" ")
        got = {k: v.strip()}
    return got


def docker_rows(text: str) -> Iterator[dict]:
    """The instructions of a Dockerfile; continued lines are joined, comments left out."""
    lines = text.replace("\r", "").split("\n")
    i, seq = 0, 0
    while i < len(lines):
        at, line = i + 1, lines[i].strip()
        i += 1
        if not line or line.startswith("#"):
            continue
        while line.endswith("\\") and i < len(lines):
            more = lines[i].strip()
            i += 1
            if not more.startswith("#"):
                line = line[:-1].rstrip() + " " + more
        word, _, rest = line.partition(" ")
        kind, rest = word.upper(), rest.strip()
        if kind not in INSTRUCTIONS:
            continue
        for m in re.finditer(r"<<-?\s*[\"']?(\w+)[\"']?", rest) if kind in ("RUN", "COPY", "ADD") else ():
            while i < len(lines) and lines[i].strip() != m.group(1):
                i += 1
            i += 1
        row: dict = {"line": at, "seq": seq, "instruction": kind, "raw": line, "image": "", "tag": "", "digest": "", "alias": "", "user_name": "", "group_name": "", "ports": [], "protocol": "", "arg_name": "", "env": {}, "labels": {}, "flags": {}, "copy_from": "", "workdir": "", "command_form": "", "volumes": []}
        seq += 1
        while (m := re.match(r"--([\w-]+)(?:=(\S+))?\s*", rest)) and kind in ("FROM", "RUN", "COPY", "ADD", "HEALTHCHECK"):
            row["flags"][m.group(1)] = m.group(2) or ""
            rest = rest[m.end() :]
        if kind == "FROM":
            parts = rest.split()
            image = parts[0] if parts else ""
            if len(parts) >= 3 and parts[1].upper() == "AS":
                row["alias"] = parts[2]
            if "@" in image:
                row["image"], _, row["digest"] = image.partition("@")
            elif ":" in image.rpartition("/")[2]:
                row["image"], _, row["tag"] = image.rpartition(":")
            else:
                row["image"] = image
            if not row["tag"] and not row["digest"]:
                row["tag"] = "latest"
        elif kind == "USER":
            row["user_name"], _, row["group_name"] = rest.partition(":")
        elif kind == "EXPOSE":
            for p in rest.split():
                port, _, proto = p.partition("/")
                if port.isdigit():
                    row["ports"].append(int(port))
                row["protocol"] = proto.lower() or row["protocol"] or "tcp"
        elif kind == "ARG":
            row["arg_name"] = rest.partition("=")[0]
        elif kind == "ENV":
            row["env"] = _pairs(rest)
        elif kind == "LABEL":
            row["labels"] = _pairs(rest)
        elif kind in ("COPY", "ADD"):
            row["copy_from"] = row["flags"].get("from", "")
        elif kind == "WORKDIR":
            row["workdir"] = rest
        elif kind == "VOLUME":
            row["volumes"] = json.loads(rest) if rest.startswith("[") and rest.endswith("]") else rest.split()
        elif kind in ("CMD", "ENTRYPOINT", "RUN", "SHELL"):
            row["command_form"] = "exec" if rest.startswith("[") else "shell"
        yield row


def _scalar(text: str) -> tuple[str, str]:
    """(value, type) of a plain or quoted YAML scalar."""
    s = re.sub(r"\s+#.*$", "", text).strip()
    if len(s) > 1 and s[0] in "\"'" and s[-1] == s[0]:
        return s[1:-1], "string"
    low = s.lower()
    kind = "boolean" if low in ("true", "false", "yes", "no", "on", "off") else "null" if low in ("null", "~", "") else "integer" if re.fullmatch(r"[-+]?\d+", s) else "double" if re.fullmatch(r"[-+]?\d*\.\d+", s) else "string"
    return s, kind


_YAML_KEY = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{}&*!|>'"%@`,?-][^#]*?|-[^\s#][^#]*?|[^\s"'#][^\s:#]*(?:\s\S[^:#]*)?)\s*:(?=\s|$)""")
_YAML_FLOW = re.compile(r"""["']|[\[\]{}]|(?<=\s)\#[^\n]*""")
_YAML_REST = re.compile(r"[ \t]*(?:#.*)?$", re.M)


def _value_end(text: str, at: int) -> int:
    """Where a quoted or bracketed value that begins at ``at`` ends; -1 if it doesn't."""
    if text[at] in "\"'":
        m = re.compile(r'"(?:[^"\\]|\\.)*"' if text[at] == '"' else r"'(?:[^']|'')*'", re.S).match(text, at)
        return m.end() if m else -1
    open_, pos = [], at
    while m := _YAML_FLOW.search(text, pos):
        c, pos = m.group()[0], m.end()
        if c in "\"'":
            if re.match(r"[\s,:\[{]", text[m.start() - 1]):
                pos = _value_end(text, m.start())
                if pos < 0:
                    return -1
        elif c in "[{":
            open_.append("]" if c == "[" else "}")
        elif c in "]}":
            if not open_ or open_.pop() != c:
                return -1
            if not open_:
                return pos
    return -1


def is_readable(text: str) -> bool:
    """Whether the text's blocks are those of a YAML document: entries in line, values that end, no line without a place."""
    text = text.replace("\r", "").lstrip("\ufeff")
    blocks: list[tuple[int, str]] = []  # open blocks: their column, and whether they are maps or sequences
    empty = plain = False  # the last entry has no value yet; it is a plain scalar that deeper lines continue
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line, begin, at = text[at:end], at, end + 1
        body = line.lstrip(" ")
        column = len(line) - len(body)
        if not body.strip() or body[0] == "#" or column == 0 and re.match(r"(?:---|\.\.\.)\s*$|%", body):
            continue
        if body[0] == "\t":
            return False
        if plain and blocks and column > blocks[-1][0] and not _YAML_KEY.match(body):
            continue
        place = begin + column
        while True:
            dash = bool(re.match(r"-(?:\s|$)", body))
            key = None if dash else _YAML_KEY.match(body)
            if not dash and not key:  # a scalar or a bracketed value by itself
                if blocks and not (empty and column > blocks[-1][0]):
                    return False
                value, start = body, place
                break
            kind = "seq" if dash else "map"
            while blocks and (column < blocks[-1][0] or column == blocks[-1][0] and kind == "map" and blocks[-1][1] == "seq" and (column, "map") in blocks):
                blocks.pop()
            if blocks and column == blocks[-1][0] and (blocks[-1][1] == kind or kind == "seq" and empty):
                if blocks[-1][1] != kind:
                    blocks.append((column, kind))
            elif not blocks or column > blocks[-1][0] and empty:
                blocks.append((column, kind))
            else:
                return False
            skip = 1 if dash else key.end()
            rest = body[skip:]
            empty = not _no_comment(rest)
            value = rest.lstrip()
            start = place + len(body) - len(value)
            if not dash or empty or not (_YAML_KEY.match(value) or re.match(r"-(?:\s|$)", value)):
                break
            column, body, place, empty = start - begin, value, start, True
        plain = False
        if not _no_comment(value):
            continue
        marked = re.match(r"(?:[&!]\S*(?:\s+|$))+", value)
        if marked:
            value, start = value[marked.end() :], start + marked.end()
        if not value or value[0] == "*":
            empty = bool(marked)
        elif value[0] in "|>":
            if not re.match(r"[|>][-+0-9]*[ \t]*(?:#.*)?$", value):
                return False
            deep = blocks[-1][0] if blocks else -1
            while at < len(text):
                stop = text.find("\n", at)
                stop = len(text) if stop < 0 else stop
                one = text[at:stop]
                if one.strip() and len(one) - len(one.lstrip(" ")) <= deep:
                    break
                at = stop + 1
        elif value[0] in "\"'[{":
            stop = _value_end(text, start)
            if stop < 0 or not _YAML_REST.match(text, stop):
                return False
            nxt = text.find("\n", stop)
            at = len(text) if nxt < 0 else nxt + 1
        else:
            if value[0] in "%@`]},&!" or re.search(r":(?:\s|$)", re.sub(r"\s#.*", "", value)):
                return False
            plain = True
        empty = empty and not value
    return True


def _no_comment(value: str) -> str:
    v = value.strip()
    return "" if v.startswith("#") else v


def compose_rows(text: str) -> Iterator[dict]:
    """The properties of a compose file's services: scalars, lists, and maps as ``key=value`` items. Anchors and block scalars stay text.

    A file that is no YAML document has none.
    """
    if not is_readable(text):
        return
    service, service_line, base, inner = "", 0, -1, -1
    in_services = False
    prop: dict | None = None
    prop_indent = -1
    for n, raw in enumerate(text.replace("\r", "").split("\n"), 1):
        body = raw.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        m = re.match(r"(\"[^\"]*\"|'[^']*'|[^\s:#\[{\"'-][^:]*?):(?:\s+(.*))?$", body)
        if indent == 0 and m:
            if prop:
                yield prop
                prop = None
            in_services = m.group(1) == "services"
            service, base, inner = "", -1, -1
            continue
        if not in_services:
            continue
        if base < 0:
            base = indent
        if indent == base and m:
            if prop:
                yield prop
                prop = None
            service, service_line, inner = m.group(1).strip("\"'"), n, -1
            continue
        if not service:
            continue
        if inner < 0:
            inner = indent
        if indent == inner and m:
            if prop:
                yield prop
            key, value = m.group(1).strip("\"'"), m.group(2) or ""
            if key.startswith("x-"):  # an extension of the format, no property
                prop = None
                continue
            prop = {"service": service, "service_line": service_line, "prop_key": key, "kind": "scalar", "scalar": None, "scalar_type": None, "prop_items": None, "line": n}
            prop_indent = indent
            if value.startswith("["):
                prop |= {"kind": "list", "prop_items": [_scalar(x)[0] for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", value) if x.strip()]}
            elif value.startswith("{"):
                prop |= {"kind": "map", "prop_items": [f"{_scalar(k)[0]}={_scalar(v)[0]}" for k, v in (x.split(":", 1) for x in value.strip("{} ").split(",") if ":" in x)]}
            elif value and not value.startswith("#"):
                s, t = _scalar(value)
                prop |= {"scalar": s, "scalar_type": t}
            continue
        if prop is None:
            continue
        if body.startswith("- ") or body == "-":
            prop["kind"] = "list"
            prop["prop_items"] = [*(prop["prop_items"] or []), _scalar(body[1:])[0]]
        elif m and indent > prop_indent and prop["kind"] != "list":
            prop["kind"] = "map"
            prop["prop_items"] = [*(prop["prop_items"] or []), f"{m.group(1).strip(chr(34) + chr(39))}={_scalar(m.group(2) or '')[0]}"]
    if prop:
        yield prop


def _mapped(files: DataFrame, schema: str, rows, lang: str) -> DataFrame:
    fields = [f.strip().split(" ", 1) for f in re.split(r",\s(?=\w+ )", schema)]
    kinds = {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [{"file": file, **r} for r in rows(text or "")]
                except (ValueError, IndexError):
                    continue
            value = lambda r, n, t: list(r[n].items()) if t.startswith("map") else r[n]
            yield pa.RecordBatch.from_arrays([pa.array([value(r, n, t) for r in out], kinds[t]) for n, t in fields], names=[n for n, _ in fields])

    return files.where(files["lang"] == lang).select("file", "content").mapInArrow(run, schema)


def scan_dockerfile(files: DataFrame) -> DataFrame:
    return _mapped(files, DOCKER, docker_rows, "dockerfile")


def scan_compose(files: DataFrame) -> DataFrame:
    return _mapped(files, COMPOSE, compose_rows, "compose")
