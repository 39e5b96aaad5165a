"""Streaming monitor and the table / model / feature-list writers."""

import os
import tempfile

from pyspark.sql import functions as F

from tabeval.operators import evaluate as ev
from tabeval.plans import fixtures as fx
from tabeval.sources import io
from tabeval.streaming import start_monitor


def test_streaming_metrics_equal_batch(spark, sf_dir):
    out = tempfile.mkdtemp(prefix="tabeval-stream-")
    batch = fx.scored(spark, sf_dir)
    batch.repartition(4).write.mode("overwrite").parquet(os.path.join(out, "scored"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(out, "scored"))
    q = start_monitor(stream, "monitor_test", output_path=os.path.join(out, "metrics"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.dataset, r.model): (r.tn, r.fp, r.fn, r.tp) for r in spark.read.parquet(os.path.join(out, "metrics")).collect()}
    want = {(r.dataset, r.model): (r.tn, r.fp, r.fn, r.tp) for r in ev.confusion(batch).collect()}
    assert got == want


def test_write_read_table_with_bom(spark):
    d = tempfile.mkdtemp(prefix="tabeval-io-")
    df = spark.createDataFrame([(1, 0.5, None), (2, float("nan"), "x")], "row_id LONG, v DOUBLE, s STRING")
    io.write_table(df, os.path.join(d, "t.csv"), fmt="csv", bom=True)
    back = io.read_table(spark, os.path.join(d, "t.csv"), schema="row_id LONG, v DOUBLE, s STRING", fmt="csv")
    assert back.columns == ["row_id", "v", "s"]
    rows = sorted(back.collect())
    assert rows[0].v == 0.5 and rows[1].v is None       # NaN became NULL at ingest
    io.write_table(df, os.path.join(d, "t.parquet"))
    assert io.read_table(spark, os.path.join(d, "t.parquet")).count() == 2


def test_save_load_model_and_features(spark):
    from tabeval.operators import classify as cl
    d = tempfile.mkdtemp(prefix="tabeval-model-")
    data = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"),
                                  (F.col("id") / 50.0).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    m = cl.spec("tree", ["a", "b"], maxDepth=3).fit(data)
    io.save_model(m, os.path.join(d, "model"))
    m2 = io.load_model(os.path.join(d, "model"))
    a = [r.p for r in m.transform(data).orderBy("row_id").collect()]
    b = [r.p for r in m2.transform(data).orderBy("row_id").collect()]
    assert a == b
    io.save_features(spark, ["glucose", "age", "bmi"], os.path.join(d, "features"))
    assert io.load_features(spark, os.path.join(d, "features")) == ["glucose", "age", "bmi"]


def test_grid_search_and_default_vs_tuned(spark):
    from tabeval.operators import classify as cl
    data = spark.range(300).select(F.col("id").alias("row_id"), ((F.col("id") * 7) % 3 == 0).cast("int").alias("y"),
                                   ((F.col("id") * 7) % 3).cast("double").alias("a"),
                                   (F.col("id") % 11).cast("double").alias("b"))
    tr, va = data.where("row_id % 4 <> 0"), data.where("row_id % 4 = 0")
    pipe = cl.spec("tree", ["a", "b"])
    table, best = cl.grid_search(cl.candidates("tree", ["a", "b"], {"maxDepth": [1, 3], "minInstancesPerNode": [1, 5]}), tr, va)
    rows = table.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == [0, 1, 2, 3] and all(r.auc == 1.0 for r in rows)
    # first strict maximum wins: ordinal 0
    assert best.stages[1].getOrDefault("maxDepth") == 1
    cmp = {r.param: (r.default, r.tuned) for r in cl.compare_params(pipe.fit(tr), best).collect()}
    assert cmp["maxDepth"] == ("5", "1")
