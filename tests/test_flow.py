import numpy as np

from coexnet.plans.experiment import Experiment
from coexnet.sources import views
from coexnet.streaming.moments import correlation_of, windowed_moments


def planted(spark):
    rng = np.random.default_rng(7)
    f = rng.normal(size=(3, 90))
    x = np.concatenate([0.9 * a + 0.5 * rng.normal(size=(25, 90)) for a in f] + [rng.normal(size=(10, 90))]) + 20
    rows = [(f"c{j}", f"g{i:02d}", float(x[i, j])) for i in range(85) for j in range(90)]
    expr = spark.createDataFrame(rows, "cell string, gene string, value double")
    cells = spark.createDataFrame([(f"c{j}", "AB"[j % 2], float(f[0, j])) for j in range(90)], "cell string, kind string, trait double")
    return expr, cells


def test_experiment(spark, tmp_path):
    e = Experiment(spark, *planted(spark)).setup("custom", genes=[f"g{i:02d}" for i in range(85)])
    e.pairs().construct_network(6, cut="static", min_size=15)
    e.write(f"file://{tmp_path}")
    e = Experiment.read(spark, f"file://{tmp_path}")
    e.module_eigengenes(["kind"]).module_connectivity()
    assert e.get("modules").where("module <> 'grey'").select("module").distinct().count() == 3
    hubs = e.get_hub_genes(5)
    assert hubs.count() == 15 and hubs.where("kme < 0.7").count() == 0
    trait = e.module_trait_correlation(["trait"]).collect()
    assert max(abs(r["cor"]) for r in trait) > 0.9 and min(r["fdr"] for r in trait) < 1e-6
    dmes = e.find_all_dmes("kind").collect()
    assert len(dmes) == 3 and all(0 <= r["p_val"] <= r["p_val_adj"] <= 1 for r in dmes)
    assert e.maybe("tf_network") is None and "tom" in repr(e)


def test_stream_equals_batch(spark, sf, tmp_path):
    events = views.read(spark, sf, "events").select("ts", "event_type", "value", "user_id")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windowed_moments(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "value", "user_id", ["event_type"], late="400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("moments").trigger(availableNow=True).start()
    q.awaitTermination()
    a = {tuple(r)[:2]: round(r["sxy"], 3) for r in spark.table("moments").collect()}
    b = {tuple(r)[:2]: round(r["sxy"], 3) for r in windowed_moments(events, "value", "user_id", ["event_type"]).collect()}
    assert a == b and correlation_of(windowed_moments(events, "value", "user_id", ["event_type"]), ["event_type"]).count() > 0


def test_csv_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("gene,c1,c2,c3\na,1,0,2\nb,0,0,3\n")
    (tmp_path / "d.csv").write_text("barcode,kind\nc3,x\nc1,y\nc9,z\n")
    expr, cells = views.read_wide_matrix(spark, f"{tmp_path}/m.csv", f"{tmp_path}/d.csv")
    assert sorted(map(tuple, expr.collect())) == [("c1", "a", 1.0), ("c3", "a", 2.0), ("c3", "b", 3.0)]
    assert {r["cell"] for r in cells.collect()} == {"c1", "c3"}
    for name, text in {"power_table": "Power,SFT.R.sq,slope,truncated.R.sq,mean.k.,median.k.,max.k.\n1,0.5,1,0.4,3,2,9\n", "modules": "gene_name,module,color\na,M1,red\n", "kME": "gene,kME_M1,kMEM2\na,0.5,0.1\n", "MEs": "M1,M2,cell\n1,2,c1\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    t = views.read_result_tables(spark, str(tmp_path))
    assert t["power_table"].columns[1:4] == ["sft_r_sq", "slope", "truncated_r_sq"] and {r["module"] for r in t["kme"].collect()} == {"M1", "M2"} and t["mes"].count() == 2


def test_default_cut_and_regulons_of_an_experiment(spark):
    """The hybrid cut, cross-validated links, regulons and scores without grey genes, one after the other."""
    e = Experiment(spark, *planted(spark)).setup("custom", genes=[f"g{i:02d}" for i in (*range(8), *range(25, 33), 80)])
    e.pairs().construct_network(6, min_size=5)
    modules = {r["gene"]: r["module"] for r in e.get("modules").collect()}
    assert len({modules[f"g{i:02d}"] for i in range(8)}) == len({modules[f"g{i:02d}"] for i in range(25, 33)}) == 1 and modules["g00"] != modules["g25"]
    motifs = spark.createDataFrame([(t, "g03") for t in ("g00", "g01", "g26")], "tf string, gene string")
    e.construct_tf_network(motifs, rounds=4, folds=2).assign_tf_regulons("A").regulon_scores("positive")
    links, errors = e.get("tf_network").collect(), e.get("tf_eval").collect()
    assert {r["tf"] for r in links} <= {"g00", "g01", "g26"} and abs(sum(r["gain"] for r in links) - 1) < 1e-9
    assert sorted(r["round"] for r in errors) == [1, 2, 3, 4] and sum(r["best"] for r in errors) == 1
    assert e.get("regulon_scores_positive").where("score < 0 or score > 1").count() == 0
    lines = e.dendrogram()[1]
    assert lines.count() == 3 * 16
