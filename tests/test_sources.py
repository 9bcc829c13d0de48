"""Files, payloads and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebars.operators import indicators as ind
from tidebars.operators import integrity, risk
from tidebars.sources import bars as src
from tidebars.streaming import live


def test_bar_files_of_both_layouts(spark, tmp_path):
    (tmp_path / "sz1_1d_2024-01-01_2024-02-01.csv").write_text(
        ",day,open,high,low,close,volume\n2024-01-02,2024-01-02,1,4,0.5,2,100\n2024-01-03,2024-01-03,2,5,1,3,\n"
    )
    (tmp_path / "sz1_1m_2024-01-01_2024-02-01.csv").write_text(
        ",open,close,high,low,volume\n2024-01-31,1,2,4,0.5,100\n2024-01-31,1,2,4,0.5,100\n"
    )
    got = src.read_bars(spark, str(tmp_path)).orderBy("timeframe", "ts").collect()
    assert [tuple(r) for r in got] == [
        ("sz1", "1d", dt.datetime(2024, 1, 2), 1, 4, 0.5, 2, 100),
        ("sz1", "1d", dt.datetime(2024, 1, 3), 2, 5, 1, 3, None),
        ("sz1", "1mo", dt.datetime(2024, 1, 31), 1, 4, 0.5, 2, 100),
    ]


def test_lines_in_a_chinese_encoding(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("行情,\"数据\n第二行\n".encode("gb2312"))
    got = src.read_lines(spark, str(tmp_path / "x.txt")).collect()
    assert [r["line"] for r in got] == ["行情,\"数据", "第二行"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_payload_of_arrays(spark):
    minute = (
        '{"data":{"sh1":{"m5":[["202401020935","1","2","3","0.5","10",{},"x"],["202401020940","2","3","4","1","20"]],'
        '"qt":{"sh1":["1","name","sh1","9.5"]}}}}'
    )
    day = '{"data":{"sh1":{"day":[["2024-01-02","7","7","7","7","7"]],"qfqday":[["2024-01-02","1","2","3","0.5","bad"]]}}}'
    df = spark.createDataFrame([("sh1", "5m", minute), ("sh1", "1d", day)], "symbol string, timeframe string, payload string")
    got = src.kline_from_json(df, "arrays").orderBy("timeframe", "ts").collect()
    assert [tuple(r) for r in got] == [
        ("sh1", "1d", dt.datetime(2024, 1, 2), 1, 3, 0.5, 2, None),
        ("sh1", "5m", dt.datetime(2024, 1, 2, 9, 35), 1, 3, 0.5, 2, 10),
        ("sh1", "5m", dt.datetime(2024, 1, 2, 9, 40), 2, 4, 1, 9.5, 20),
    ]


def test_payload_of_objects(spark):
    text = '[{"day":"2024-01-02 09:35:00","open":"1","high":"x","low":"1","close":"2","volume":"3"}]'
    df = spark.createDataFrame([("s", "5m", text), ("s", "5m", "[]")], "symbol string, timeframe string, payload string")
    got = src.kline_from_json(df, "objects").collect()
    assert [tuple(r) for r in got] == [("s", "5m", dt.datetime(2024, 1, 2, 9, 35), 1, None, 1, 2, 3)]


def test_stored_bars_prune_partitions(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    src.write_bars(bars([(0, 1.0)]).unionByName(bars([(0, 2.0)], symbol="y")), path)
    got = src.read_stored_bars(spark, path).filter("symbol = 'y'")
    assert "PartitionFilters: [isnotnull(symbol" in got._jdf.queryExecution().executedPlan().toString()
    assert got.first()["close"] == 2.0


@pytest.fixture
def tick_files(spark, tmp_path):
    """Ticks in four files, to be read one per batch."""
    path = str(tmp_path / "ticks")
    start = dt.datetime(2024, 1, 1)
    rows = [("x", start + dt.timedelta(minutes=2 * i), float((i * 37) % 101 + 1)) for i in range(400)]
    for part in range(4):
        chunk = rows[part * 100 : part * 100 + 100]
        spark.createDataFrame(chunk, "symbol string, ts timestamp, price double").coalesce(1).write.mode("append").parquet(path)
    schema = "symbol string, ts timestamp, price double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, spark.createDataFrame(rows, schema)


def batch_bars(ticks, minutes):
    slot = F.window("ts", f"{minutes} minutes")
    return ticks.groupBy("symbol", slot).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.count("*").cast("double").alias("volume"),
    ).select("symbol", F.lit(f"{minutes}m").alias("timeframe"), F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def test_stream_of_bars_is_the_batch(spark, tick_files):
    stream, ticks = tick_files
    got = live.run_to_table(live.stream_bars(live.ticks(stream, "symbol", "price"), 15), "bars")
    want = batch_bars(ticks, 15).filter("ts < '2024-01-01 13:00:00'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_live_trading_over_batches_is_the_batch(spark, tick_files, tmp_path):
    stream, ticks = tick_files

    def process(bars):
        return ind.with_indicators(bars, ind.sma(20), ind.momentum(10)).select("symbol", "timeframe", "ts", "ma_20", "mom")

    bars = live.stream_bars(live.ticks(stream, "symbol", "price"), 15)
    out = str(tmp_path / "out")
    live.live_trading(bars, process, str(tmp_path / "buffer"), out, str(tmp_path / "cp"), buffer=40).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() > 2
    want = process(batch_bars(ticks, 15)).filter("ts < '2024-01-01 13:00:00'")

    def rows(df):
        return sorted((r["ts"], round(r["ma_20"], 9), r["mom"]) for r in df.collect())

    assert rows(got) == rows(want)


def test_stop_monitor(spark, tick_files):
    stream, ticks = tick_files
    moves = live.stop_monitor(stream.withColumn("pnl", F.lit(-0.001)), watermark="1 minute")
    assert moves.isStreaming
    day = live.stop_monitor(ticks.withColumn("pnl", F.lit(-0.001))).collect()
    assert [r["stop"] for r in day] == [True] and day[0]["day_pnl"] == pytest.approx(-0.4)


def test_breaches_come_at_once_and_once(spark, tmp_path):
    """A day that falls by 5 % and recovers, over three batches; the same as the running loss of the batch operator."""
    import datetime as dt

    day = dt.datetime(2024, 1, 2, 9)
    pnl = [0.0, -0.015, -0.01, -0.025, 0.06, -0.1, 0.2]
    price = [100.0, 101.0, 95.0, 111.0, 100.0, 130.0, 100.0]
    schema = "symbol string, ts timestamp, pnl double, price double"
    for i in range(0, 7, 3):
        rows = [("a", day + dt.timedelta(minutes=j), pnl[j], price[j]) for j in range(i, min(i + 3, 7))]
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    got = {r["kind"]: (r["ts"].minute, round(r["value"], 6)) for r in live.run_to_table(live.first_breaches(stream), "breach").collect()}
    assert got == {"stop": (2, -0.025), "pause": (3, 0.11)}
    bars = spark.read.schema(schema).json(str(tmp_path / "in/*")).withColumns({"timeframe": F.lit("1min"), "ts": F.col("ts").cast("timestamp_ntz")})
    assert risk.daily_loss_limit(bars).filter("stop").agg(F.min("ts").alias("t")).first()["t"].minute == 2


def test_checks_of_files_see_every_line(spark, tmp_path):
    (tmp_path / "sz1_1d_2024-01-01_2024-02-01.csv").write_text(
        ",day,open,high,low,close,volume\n0,2024-01-02,1,4,0.5,2,100\n1,2024-01-03,x,5,1,3,7\n2,bad,2,5,1,3,7\n3,2024-01-03,2,5,1,3,7\n4,2024-13-45,2,5,1,3,7\n"
    )
    (tmp_path / "sz2_1d_2024-01-01_2024-02-01.csv").write_text(",day,open,high,low,close\n0,2024-01-02,1,4,0.5,2\n")
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    lines = src.read_raw_bars(spark, str(tmp_path))
    holidays = spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date")
    found = integrity.check_files(lines, holidays).collect()
    by_check = {c: sorted(str(r["observed"]) for r in found if r["check"] == c) for c in {r["check"] for r in found}}
    assert by_check["unmatched_file"] == ["notes.csv"]
    assert by_check["bad_time"] == ["2024-13-45", "bad"]
    assert by_check["duplicate"] == ["2"]
    assert [r["reasons"] for r in found if r["check"] == "missing_column"] == [["volume"]]
    assert [(r["column"], r["observed"]) for r in found if r["check"] == "numeric" and r["symbol"] == "sz1"] == [("open", "x")]
    assert src.read_bars(spark, str(tmp_path)).count() == 3
