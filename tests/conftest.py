from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tidebars-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def bars(spark):
    """Make a bar table of one series from rows of (day, close) or (day, o, h, l, c, v)."""

    def build(rows, symbol="x", timeframe="1d", start=dt.datetime(2024, 1, 1)):
        made = []
        for row in rows:
            day, rest = row[0], list(row[1:])
            ts = day if isinstance(day, dt.datetime) else start + dt.timedelta(days=day)
            if len(rest) == 1:
                rest = [rest[0]] * 4 + [1.0]
            made.append((symbol, timeframe, ts, *rest))
        schema = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
        return spark.createDataFrame(made, schema)

    return build


def column(df, name):
    """The values of a column in time order."""
    return [r[name] for r in df.orderBy("symbol", "timeframe", "ts").select(name).collect()]


@pytest.fixture
def values():
    return column


@pytest.fixture(scope="session")
def walk(spark):
    """A long daily walk of two series, and the same as pandas frames."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("a", 700), ("b", 45)):
        close = 100 + rng.normal(0, 1, n).cumsum()
        high, low = close + rng.random(n), close - rng.random(n)
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol, "timeframe": "1d", "ts": pd.date_range("2020-01-01", periods=n, freq="D"),
                    "open": close, "high": high, "low": low, "close": close,
                    "volume": rng.integers(1, 100, n).astype(float),
                }
            )
        )
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).selectExpr(
        "symbol", "timeframe", "cast(ts as timestamp_ntz) ts", "open", "high", "low", "close", "volume"
    )
    return df.cache(), {s: f.reset_index(drop=True) for s, f in pdf.groupby("symbol")}
