from tabeval.sources.io import (  # noqa: F401
    load_features, load_model, read_table, save_features, save_model, testdata_table, write_table,
)
