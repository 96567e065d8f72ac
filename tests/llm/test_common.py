import pytest
from pyspark.sql import functions as F

from coexnet.llm import common
from coexnet.llm.graph import connected_components


def test_attach_spreads_keys_with_many_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 7)], "k long, v long")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).where("k is not null")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.attach(rows, keyed, "k", how).select("k", "v", "top").collect()), key=str)
        want = sorted(map(tuple, rows.join(keyed.drop("n"), "k", how).select("k", "v", "top").collect()), key=str)
        assert got == want
    assert common.attach(rows.limit(0), keyed.limit(0), "k").count() == 0


def test_components_of_stars_and_chains(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    edges = [(1000, i) for i in range(1, 400)] + [(2000 + i, 2001 + i) for i in range(70)] + [(5, 5), (None, 3), (1000, 1)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(1, 400), 1000]}, **{2000 + i: 2000 for i in range(71)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
    assert common.unused(spark.range(1).selectExpr("id as __ID", "id as b"), "__id", "c") == ["___id", "c"]
