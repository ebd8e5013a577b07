import base64
import gzip
import json

from pyspark.sql import functions as F

from codelattice.operators.flatten import REGISTRY, find_root, flat_tables, flatten_records, parent_label

RECORD = {
    "module": "m", "functions": {"f": {"params": [{"name": "a"}, None, {"name": "b"}], "returns": {"type": "int"}, "doc": "d"}, "g": {}, "h": None, "i": "text"}, "classes": {"C": {"methods": {"m": {"params": []}}, "attributes": {"x": {"type": "int"}}, "inherited_methods": None}},
    "constants": [{"name": "K", "value": 1}, {"value": 2}], "unknown": {"z": {}},
}
PATHS = {"functions/f", "functions/f/params/0", "functions/f/params/2", "functions/f/returns/0", "functions/g", "classes/C", "classes/C/methods/m", "classes/C/attributes/x", "constants/K"}


def paths(spark, payloads):
    df = spark.createDataFrame([(i, p, "junk") for i, p in enumerate(payloads)], "rid bigint, payload string, name string")
    return flatten_records(df, "rid", "payload")


def test_all_members(spark):
    rows = paths(spark, [json.dumps(RECORD)]).collect()
    assert {r.obj_path for r in rows} == PATHS
    by = {r.dewey: r for r in rows}
    for r in rows:
        assert r.parent_path == ("/".join(r.obj_path.split("/")[:-2]))
        assert r.parent_dewey == "" or by[r.parent_dewey].obj_path == r.parent_path
    assert json.loads(next(r.attributes for r in rows if r.obj_path == "functions/f")) == {"doc": "d"}


def test_wrappings(spark):
    text = json.dumps(RECORD)
    wrapped = [text, json.dumps(text), json.dumps({"data": RECORD}), json.dumps([{"x": 1}, RECORD]), json.dumps({"body": text}), "﻿" + text, base64.b64encode(text.encode()).decode(), base64.b64encode(gzip.compress(text.encode())).decode(), json.dumps({"a": {"b": json.dumps(json.dumps(RECORD))}})]
    got = paths(spark, wrapped).groupBy("rid").agg(F.collect_set("obj_path").alias("p")).collect()
    assert len(got) == len(wrapped) and all(set(r.p) == PATHS for r in got)


def test_short_encoded_payloads(spark):
    """Encoded records of any length, in wrappers too."""
    small = json.dumps({"module": "m", "functions": {"f": {}}})
    code = base64.b64encode(small.encode()).decode()
    tiny = base64.b64encode(b'{"module":1}').decode()
    assert len(code) < 64
    got = {tuple(r.p) for r in paths(spark, [code, json.dumps({"data": code}), json.dumps([{"x": {"y": code}}]), code[:20] + "\n" + code[20:]]).groupBy("rid").agg(F.sort_array(F.collect_set("obj_path")).alias("p")).collect()}
    assert got == {("functions/f",)}
    assert find_root(tiny, REGISTRY) == {"module": 1} and find_root(json.dumps({"a": tiny}), REGISTRY) == {"module": 1}


def test_what_gives_nothing(spark):
    bad = [None, "", "  ", "{", json.dumps(RECORD)[:-3], "[]", "null", "7", '"x"', json.dumps({"functions": {"f": {}}}), "[" * 5000]
    assert paths(spark, bad).count() == 0


def test_tables_and_links(spark):
    nodes = paths(spark, [json.dumps(RECORD), json.dumps(RECORD)])
    tables = flat_tables(nodes, ["functions", "functions/params"])
    assert tables["functions"].count() == 4 and tables["functions/params"].count() == 4
    joined = tables["functions/params"].alias("p").join(tables["functions"].alias("f"), (F.col("p.rid") == F.col("f.rid")) & (F.col("p.parent_dewey") == F.col("f.dewey")))
    assert joined.count() == 4
    assert nodes.where(parent_label() != F.col("parent_dewey")).count() == 0


def test_a_record_of_many_members(spark):
    big = {"module": "m", "functions": {f"f{i}": {"params": [{}] * 3} for i in range(20_000)}}
    assert paths(spark, [json.dumps(big)]).count() == 80_000


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "id string, payload string, dewey string, coll int")
    assert flatten_records(df, "id", "payload").count() == 0
