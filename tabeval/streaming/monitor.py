"""The evaluation aggregates over a Structured Streaming source of scored rows.

The reference reads whole files only; nothing in it is a stream.  What carries
over unchanged is that the additive evaluation operators are plain grouped
aggregations, so Structured Streaming keeps them up to date as scored rows
arrive: confusion counts (hence accuracy, precision, sensitivity, specificity,
F1) and the calibration table.  The rank-based ones (AUC, ROC) need the whole
ordered set of scores and stay batch operators over the accumulated table.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabeval.operators.evaluate import KEYS, calibration, class_metrics, confusion
from tabeval.session import checkpoint_dir


def streaming_metrics(scored_stream: DataFrame, cut: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Confusion counts and the class metrics, kept current per (dataset, model)."""
    return class_metrics(confusion(scored_stream, cut, keys))


def streaming_calibration(scored_stream: DataFrame, n_bins: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    return calibration(scored_stream, n_bins, keys)


def start_monitor(scored_stream: DataFrame, name: str, sink: str = "table", cut: float = 0.5,
                  keys: Sequence[str] = KEYS, trigger_seconds: int | None = None,
                  output_path: str | None = None) -> StreamingQuery:
    """Start the metrics query.  Its state checkpoint goes under the shared
    checkpoint folder, so a restarted driver resumes where it stopped."""
    spark = scored_stream.sparkSession
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = (streaming_metrics(scored_stream, cut, keys).writeStream
         .outputMode("complete").queryName(name).option("checkpointLocation", ckpt))
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    if sink == "memory":
        return w.format("memory").start()
    if output_path is None:
        output_path = os.path.join(checkpoint_dir(spark), "streams", name + "-metrics")
    # complete-mode results re-written per micro-batch: a table, not the driver's memory
    return w.foreachBatch(lambda df, _epoch: df.write.mode("overwrite").parquet(output_path)).start()
