"""Tables in the engine's shapes, from raw chain data, lists and Parquet."""
