"""Paths, contracts and numbers that go deeper or are written differently than the registered fixtures."""

from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.operators import edges


def test_shape_paths_have_no_depth_limit(spark):
    doc = '{"a":' * 12 + '["x{[\\"", {"b": 1}]' + "}" * 12
    df = spark.createDataFrame([(doc,), ('{"k":2}',)], "j string").select(F.parse_json("j").alias("v"))
    found = {tuple(r.paths) for r in D.shape_paths(df).collect()}
    deep = max(found, key=len)
    assert ".".join("a" * 12) in deep and ".".join("a" * 12) + "[].b" in deep and ("k",) in found
    assert {r[0] for r in df.select(D.nesting(F.col("v"))).collect()} == {14, 1}


def test_closure_goes_on_to_the_end(spark):
    chain = spark.createDataFrame([(f"T/{i}", f"T/{i + 1}") for i in range(9)] + [("T/9", "T/0")], "src_ref string, dst_ref string")
    refs = spark.createDataFrame([(f"T/{i}",) for i in range(10)], "ref string")
    seeds = spark.createDataFrame([("P/1", "T/0")], "patient_ref string, ref string")
    assert edges.closure(seeds, chain, refs).count() == 10


def test_numbers_compare_by_value(spark):
    same = [("1e10", "10000000000"), ("1e-7", "0.0000001"), ("1.50", "1.5"), ("-0.0", "0"), ("1e20", "100000000000000000000")]
    other = [("true", "1"), ("9007199254740993", "9007199254740992"), ("1.5", "1.51"), ('"1e3"', "1000")]
    rows = spark.createDataFrame([(f'{{"a":[{x},"-0 1.0"]}}', f'{{"a":[{y},"-0 1.0"]}}') for x, y in same + other], "x string, y string")
    equal = [r[0] for r in rows.select(D.canonical(F.parse_json("x")) == D.canonical(F.parse_json("y"))).collect()]
    assert equal == [True] * len(same) + [False] * len(other)
