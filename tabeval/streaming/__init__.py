from tabeval.streaming.monitor import start_monitor, streaming_calibration, streaming_metrics  # noqa: F401
