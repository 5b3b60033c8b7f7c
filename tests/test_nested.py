import json

from pyspark.sql import functions as F

from conftest import rows_of
from cuelake.operators.nested import flatten_nested, merged_schema, payload_tables, readable_payloads


def test_children_carry_parent_keys_and_ordinals(spark):
    df = spark.createDataFrame([(1, {"a": 5, "xs": [{"b": "p", "ys": [1, 2]}, {"b": None, "ys": None}]}), (2, None)], "id long, r struct<a:int,xs:array<struct<b:string,ys:array<int>>>>")
    t = flatten_nested(df, "id", "r")
    assert set(t) == {"root", "root_xs", "root_xs_ys"}
    assert rows_of(t["root"].select("id", "a")) == [(1, 5), (2, None)]
    assert rows_of(t["root_xs"].select("id", "_parent", "_ord", "b")) == [(1, "1", 0, "p"), (1, "1", 1, None)]
    assert rows_of(t["root_xs_ys"].select("_parent", "_ord", "value")) == [("1/xs/0", 0, 1), ("1/xs/0", 1, 2)]
    joined = t["root_xs_ys"].alias("c").join(t["root_xs"].alias("p"), F.col("c._parent") == F.col("p._key"))
    assert joined.count() == 2


def test_clashing_names_get_underscores(spark):
    df = spark.createDataFrame([(1, {"id": 7, "_key": "k"})], "id long, r struct<id:int,_key:string>")
    assert flatten_nested(df, "id", "r")["root"].columns == ["id", "_key", "_parent", "_ord", "id_", "_key_"]


def test_merged_schema_unites_fields(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"b":[{"c":2}]}',), (None,)], "p string")
    assert merged_schema(df, "p").simpleString() == "struct<a:string,b:array<struct<c:string>>>"


def readable(text):
    def number(x):
        try:
            float(x)
        except (TypeError, ValueError):
            return False
        return not isinstance(x, bool)

    try:
        d = json.loads(text.removeprefix("﻿"))
    except (ValueError, AttributeError):
        return False
    return isinstance(d, dict) and isinstance(d.get("segments"), list) and all(isinstance(s, dict) and all(isinstance(x, dict) and number(x.get("start")) and number(x.get("end")) for x in [s, *(s.get("words") or [])]) for s in d["segments"])


def test_readable_payloads_equal_plain_json(spark, edge_folder):
    df = spark.read.parquet(f"{edge_folder}/raw_transcripts.parquet")
    more = ['{"segments":[{"start":1,"end":2},5]}', "[]", '"x"', "null", "{}", '{"segments":[{"start":"1e3","end":" 2 "}],"more":{"x":[1]}}', "{'segments':[]}", '{"segments":[]}{"segments":[]}', '{"segments":[{"start":true,"end":1}]}', '{"segments":[[1]]}', '{"segments":"abc"}']
    df = df.select("raw_id", "payload").unionByName(spark.createDataFrame([(100 + i, p) for i, p in enumerate(more)], "raw_id long, payload string"))
    want = sorted(r.raw_id for r in df.collect() if readable(r.payload))
    assert sorted(r.raw_id for r in readable_payloads(df).collect()) == want
    assert payload_tables(df)["transcript"].count() == len(want)


def test_no_payloads(spark, empty_folder):
    tables = payload_tables(spark.read.parquet(f"{empty_folder}/raw_transcripts.parquet"))
    assert all(t.count() == 0 for t in tables.values())
    assert "transcript_segments_words" in tables
