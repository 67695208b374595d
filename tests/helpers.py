from datetime import datetime, timedelta, timezone

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "tx_hash string, from_address string, to_address string, value_usd double, timestamp timestamp, chain string, asset string, block_number long"


def legs(spark, rows):
    """(from, to, value, seconds after the start[, hash[, chain]]) as transfers."""
    out = []
    for i, (a, b, v, at, *more) in enumerate(rows):
        out.append((more[0] if more else f"tx{i:04d}", a, b, float(v), T0 + timedelta(seconds=at), more[1] if len(more) > 1 else "ethereum", "ETH", i))
    return spark.createDataFrame(out, SCHEMA)
