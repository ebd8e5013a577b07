"""The facts that a source file yields, as nested columns: parsed once, exploded into tables as needed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARGUMENT = "struct<value:string,is_variable:boolean,position:int>"
TABLES = {
    "nodes": "struct<type:string,name:string,fqn:string,line:int,end_line:int,modifier:string,return_type:string,params:array<string>,bases:array<string>,annotations:array<string>,value:string,doc:string>",
    "call_sites": f"struct<caller_fqn:string,target:string,line:int,col:int,arguments:array<{ARGUMENT}>>",
    "statements": "struct<fqn:string,seq:int,flat_seq:int,block:int,line:int,type:string,def:string,uses:array<string>,call_target:string,call_chain:string,attribute_access:string,call_args:array<string>>",
    "imports": "struct<alias:string,fqn:string,level:int,line:int>",
    "bindings": "struct<scope_fqn:string,var:string,line:int,type_fqn:string,confidence:double,source:string>",
    "class_attributes": "struct<class_fqn:string,name:string,type_fqn:string,confidence:double>",
    "returns": "struct<fqn:string,type_fqn:string,confidence:double>",
    "cfg_edges": "struct<fqn:string,src:int,dst:int,kind:string>",
}


def _arrow(table: str) -> pa.DataType:
    def kind(s: str) -> pa.DataType:
        if s.startswith("array<"):
            return pa.list_(kind(s[6:-1]))
        if s.startswith("struct<"):
            fields, depth, part = [], 0, ""
            for c in s[7:-1] + ",":
                depth += (c == "<") - (c == ">")
                if c == "," and depth == 0:
                    n, _, t = part.partition(":")
                    fields.append(pa.field(n, kind(t)))
                    part = ""
                else:
                    part += c
            return pa.struct(fields)
        return {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[s]

    return pa.list_(kind(TABLES[table]))


def parsed(files: DataFrame, extract: Callable[[str, str], dict[str, list[dict]]]) -> DataFrame:
    """``(file, module, ok, <tables>)`` for files (file, module, content). Files that can't be parsed give no facts and ``ok`` false."""
    names = list(TABLES)
    types = {n: _arrow(n) for n in names}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            ok: list[bool] = []
            for module, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    rows.append(extract(text or "", module or ""))
                    ok.append(True)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append({})
                    ok.append(False)
            cols = [pa.array([r.get(n, []) for r in rows], types[n]) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok), *cols], names=["file", "module", "ok", *names])

    schema = "file string, module string, ok boolean, " + ", ".join(f"{n} array<{t}>" for n, t in TABLES.items())
    return files.select("file", "module", "content").mapInArrow(run, schema)


def table_of(facts: DataFrame, name: str) -> DataFrame:
    """One of the tables: (file, module, its columns)."""
    return facts.select("file", "module", F.explode(name).alias("_r")).select("file", "module", "_r.*")
