"""Seeded inputs of the tests."""

import numpy as np
import pandas as pd

DAY = 86_400_000


def walk(tickers=3, days=300, seed=42, start=10**12, suffix=".NZ"):
    """Geometric random walks as an OHLCV panel."""
    rng = np.random.default_rng(seed)
    frames = []
    for k in range(tickers):
        close = 100 * np.exp(np.cumsum(rng.normal(0.0002, 0.02, days)))
        high, low = close * (1 + rng.uniform(0, 0.02, days)), close * (1 - rng.uniform(0, 0.02, days))
        frames.append(pd.DataFrame({
            "timestamp": start + DAY * np.arange(days), "ticker": f"STOCK{k:02d}{suffix}", "Open": low + (high - low) * rng.uniform(0, 1, days),
            "High": high, "Low": low, "Close": close, "AdjClose": close, "Volume": np.floor(1000 + rng.exponential(5000, days)),
        }))
    return pd.concat(frames, ignore_index=True)


def skewed(n=400, seed=7):
    """One key with a third of the rows and many ties, and a sparse column."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.uniform(size=n) < 0.34, "hot", np.char.add("k", rng.integers(0, 9, n).astype(str)))
    value = np.where(rng.uniform(size=n) < 0.33, 5.0, np.round(rng.normal(size=n), 2))
    return pd.DataFrame({
        "k": key, "t": rng.permutation(n), "v": value, "s": np.where(rng.uniform(size=n) < 0.1, value, np.nan),
    })


def frame(spark, pdf):
    """pandas to Spark with NaN as null."""
    rows = pdf.astype(object).where(pdf.notna(), None)
    names = {"int64": "bigint", "float64": "double", "object": "string", "bool": "boolean", "int32": "int"}
    schema = ", ".join(f"`{c}` {names[str(t)]}" for c, t in pdf.dtypes.items())
    return spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], schema)
