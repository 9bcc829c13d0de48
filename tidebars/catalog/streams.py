"""Text and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.inputs import W, query, rounded, table
from tidebars.catalog.windows import ACCURACY, EPS, recursive_emas, roll
from tidebars.functions import columns as fn
from tidebars.operators import indicators as ind
from tidebars.operators import signals as sg
from tidebars.operators import text
from tidebars.plans import analysis
from tidebars.series import new_path
from tidebars.streaming import cycle, live


def numbered_lines(spark, sf):
    """Lines of the documents, numbered per document."""
    return text.lines_of(table(spark, sf, "documents"))


LINES = r"""
split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i AS pos, ls[i + 1] AS line FROM split, unnest(range(len(ls))) AS g(i)),
marked AS (SELECT *, starts_with(regexp_replace(line, '^\s+|\s+$', '', 'g'), 'The') AS is_start,
                  ends_with(regexp_replace(line, '^\s+|\s+$', '', 'g'), 's.') AS is_end FROM lines),
segs AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM marked),
bounds AS (SELECT *, min(CASE WHEN is_start THEN pos END) OVER (PARTITION BY doc_id, seg) AS first_start,
                  max(CASE WHEN is_end THEN pos END) OVER (PARTITION BY doc_id, seg) AS last_end FROM segs)"""
query(
    "stitch_records",
    f"""WITH {LINES} SELECT doc_id, last_end AS pos, string_agg(line, ' | ' ORDER BY pos) AS record FROM bounds
    WHERE pos >= first_start AND last_end IS NOT NULL GROUP BY doc_id, seg, last_end""",
)(
    lambda spark, sf: text.stitch_records(numbered_lines(spark, sf), "The", "s.", sep=" | ").withColumn(
        "pos", F.col("pos").cast("bigint")
    )
)
query(
    "split_regex",
    r"SELECT doc_id, len(regexp_split_to_array(text, '[,.]\s+')) AS parts, regexp_split_to_array(text, '[,.]\s+')[1] AS head FROM documents",
)(
    lambda spark, sf: table(spark, sf, "documents")
    .withColumn("_p", fn.split_regex(F.col("text"), r"[,.]\s+"))
    .select("doc_id", F.size("_p").cast("bigint").alias("parts"), F.get("_p", F.lit(0)).alias("head"))
)
query(
    "join_nonempty",
    """SELECT doc_id, coalesce(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: x <> ''), 'string_agg', ';') || ';', '') AS joined
    FROM documents""",
)(
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", fn.join_nonempty(F.split("text", "\n"), ";").alias("joined")
    )
)
query(
    "trim_equals",
    "SELECT conv_id, turn, role = 'user' AS is_user FROM conversations",
)(
    lambda spark, sf: table(spark, sf, "conversations").select(
        "conv_id", "turn",
        fn.trim_equals(F.concat(F.lit(" \t"), F.col("role"), F.lit("\n ")), "user").alias("is_user"),
    )
)


# --- streams ---------------------------------------------------------------
def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


# A stream leaves its last bars open: those the watermark, ten minutes behind
# the newest event, has not passed.
TICK_BARS = """
bars AS (
  SELECT event_type AS symbol, '15m' AS timeframe, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
         arg_min(value, e.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, e.ts) AS close,
         count(*)::DOUBLE AS volume FROM events e GROUP BY 1, 2, 3),
closed AS (SELECT * FROM bars
  WHERE ts + INTERVAL 15 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events))"""


@query("stream_bars", f"WITH {TICK_BARS} SELECT * FROM closed")
def stream_bars(spark, sf):
    stream = live.stream_bars(live.ticks(event_stream(spark, sf), "event_type", "value"), 15)
    return live.run_to_table(stream, "bars")


def to_trades(bars):
    """Trades of a buffer of bars: moving averages to scores to signals."""
    known = ind.with_indicators(bars, ind.trend_strength(), ind.atr(), ind.sma(5))
    scores = known.withColumns(
        {
            "p0": F.try_divide(F.col("close") - F.col("ma_5"), F.col("ma_5")),
            "p1": F.lit(0.6), "p2": F.lit(1.5), "dynamic_weight": F.lit(0.5),
        }
    )
    made = sg.signals(scores)
    return analysis.trades(made, made.select("symbol", "timeframe", "ts", "dynamic_weight"))


TRADES = f"""
lagged AS (SELECT *, lag(close) OVER ({W}) AS prev FROM closed),
known AS (SELECT *, avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma_5,
  avg(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma_20,
  greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM lagged),
trades AS (SELECT symbol, timeframe, ts, round(least(abs((close - ma_5) / ma_5), 1), 6) AS position_size,
  CASE WHEN (ma_5 - ma_20) / ma_20 > 0.03 THEN 1.0 ELSE 0.0 END AS entry_level,
  round(1.5 * avg(tr) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS stop_loss, 0.5 AS dynamic_weight
  FROM known)"""
TRADE_COLUMNS = ["position_size", "stop_loss"]


@query("live_trading", f"WITH {TICK_BARS},{TRADES} SELECT * FROM trades")
def live_trading(spark, sf):
    stream = live.stream_bars(live.ticks(event_stream(spark, sf), "event_type", "value"), 15)
    buffer, trades, checkpoint = (new_path(spark, n) for n in ("buffer", "trades", "checkpoint"))
    live.live_trading(stream, to_trades, buffer, trades, checkpoint).awaitTermination()
    stored = spark.read.parquet(trades).drop("batch_id")
    return rounded(stored, 6, *TRADE_COLUMNS)


@query("emit_trades", f"WITH {TICK_BARS},{TRADES} SELECT * FROM trades")
def emit_trades(spark, sf):
    stream = live.stream_bars(live.ticks(event_stream(spark, sf), "event_type", "value"), 15)
    bars = live.run_to_table(stream, "bars")
    path, checkpoint, source = (new_path(spark, n) for n in ("log", "checkpoint", "source"))
    made = to_trades(bars)
    made.write.parquet(source)
    live.emit_trades(spark.readStream.schema(made.schema).parquet(source), path, checkpoint).awaitTermination()
    return rounded(spark.read.parquet(path).drop("batch_id", "logged_at"), 6, *TRADE_COLUMNS)


@query(
    "stop_monitor",
    """WITH d AS (SELECT event_type AS symbol, ts::DATE::TIMESTAMP AS day, sum(100 - value) / 1e4 AS day_pnl,
      arg_min(value, ts) AS a, arg_max(value, ts) AS b FROM events GROUP BY 1, 2)
    SELECT symbol, day, round(day_pnl, 6) AS day_pnl, round((b - a) / a, 6) AS change, -day_pnl >= 0.02 AS stop,
           abs((b - a) / a) > 0.1 AS pause FROM d
    WHERE day + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def stop_monitor(spark, sf):
    ticks = event_stream(spark, sf).select(
        F.col("event_type").alias("symbol"), "ts", ((100 - F.col("value")) / 1e4).alias("pnl"),
        F.col("value").alias("price"),
    )
    return rounded(live.run_to_table(live.stop_monitor(ticks), "stops"), 6, "day_pnl", "change")


@query(
    "first_breaches",
    """WITH r AS (SELECT event_type AS symbol, ts::DATE::TIMESTAMP AS day, ts,
      sum((100 - value) / 1e4) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts) AS total,
      value / first_value(value) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts) - 1 AS move FROM events)
    SELECT symbol, day, 'stop' AS kind, min(ts) AS ts, round(arg_min(total, ts), 6) AS value FROM r WHERE -total >= 0.02 GROUP BY 1, 2
    UNION ALL
    SELECT symbol, day, 'pause', min(ts), round(arg_min(move, ts), 6) FROM r WHERE abs(move) > 0.1 GROUP BY 1, 2""",
)
def first_breaches(spark, sf):
    ticks = event_stream(spark, sf).select(
        F.col("event_type").alias("symbol"), "ts", ((100 - F.col("value")) / 1e4).alias("pnl"),
        F.col("value").alias("price"),
    )
    found = live.run_to_table(live.first_breaches(ticks), "breaches")
    zone_free = {c: F.col(c).cast("timestamp_ntz") for c in ("day", "ts")}
    return rounded(found.withColumns(zone_free), 6, "value")


# --- the live cycle --------------------------------------------------------
def event_batches(spark, sf, slot, batches):
    """The events as a stream of one file a batch; ``slot`` says which batch an event comes in."""
    events, path = table(spark, sf, "events").withColumn("_slot", slot), new_path(spark, "event-batches")
    for i in range(batches):
        events.filter(F.col("_slot") == i).drop("_slot").coalesce(1).write.parquet(f"{path}/batch={i}")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def by_day(moment, days, batches):
    """Batches of ``days`` days of January, the rest in the last."""
    return F.least(F.floor((F.dayofmonth(moment) - 1) / days), F.lit(batches - 1))


CYCLE_SQL = (
    recursive_emas(TICK_BARS, "closed", ["macd_signal", "diff", "dea", "up2", "size2"])
    + ACCURACY
    + f""",
a AS (SELECT symbol, timeframe, ts, avg(correct_signal) OVER {roll(20)} AS accuracy FROM h),
known AS (
  SELECT b.symbol, b.timeframe, b.ts, accuracy, up2 / CASE WHEN size2 = 0 THEN {EPS} ELSE size2 END AS p0,
         avg(greatest(coalesce(change, 0), 0)) OVER w14 AS gain, avg(greatest(coalesce(-change, 0), 0)) OVER w14 AS loss,
         avg(close) OVER w5 AS ma_5, avg(close) OVER w20 AS ma_20, close / nullif(close - change, 0) - 1 AS ret,
         avg(greatest(high - low, abs(high - (close - change)), abs(low - (close - change)))) OVER w14 AS atr
  FROM b JOIN e USING (symbol, timeframe, r) JOIN a ON a.symbol = b.symbol AND a.timeframe = b.timeframe AND a.ts = b.ts
  WINDOW w5 AS (PARTITION BY b.symbol, b.timeframe ORDER BY b.ts ROWS 4 PRECEDING),
         w14 AS (PARTITION BY b.symbol, b.timeframe ORDER BY b.ts ROWS 13 PRECEDING),
         w20 AS (PARTITION BY b.symbol, b.timeframe ORDER BY b.ts ROWS 19 PRECEDING)),
rated AS (
  SELECT *, 1 - 1 / (1 + gain / CASE WHEN loss = 0 THEN {EPS} ELSE loss END) AS p1, (ma_5 - ma_20) / ma_20 AS trend,
         stddev_samp(ret) OVER {roll(20)} * sqrt(252) AS vol FROM known),
risky AS (SELECT *, coalesce(vol / max(vol) OVER ({W}), 0) AS risk FROM rated)
SELECT symbol, timeframe, ts, round(p0 * (1 - risk), 6) AS signal_strength, round(least(abs(p0), 1), 6) AS position_size,
       round((CASE WHEN p1 > 0.7 AND trend > 0.05 THEN 2.0 WHEN p1 > 0.5 AND p1 <= 0.7 AND trend > 0.03 THEN 1.0
                   WHEN p1 > 0.3 AND p1 <= 0.5 AND trend > 0.01 THEN 0.5 ELSE 0.0 END) * (1 + risk), 6) AS entry_level,
       round(1.5 * atr * (1 - risk), 6) AS stop_loss,
       round(1 / (1 + exp(-(p0 * (1 + accuracy) * (1 + trend) * vol))), 6) AS dynamic_weight
FROM risky"""
)


@query("live_cycle", CYCLE_SQL)
def live_cycle(spark, sf):
    """Six batches of events: bars, features with carried averages, signals, risk, trades in an upsert store."""
    stream = event_batches(spark, sf, by_day(F.col("ts"), 5, 6), 6)
    bars = live.stream_bars(live.ticks(stream, "event_type", "value"), 15, closing="closes")
    strength = F.col("tsi") / 100
    scores = {
        "p0": strength, "p1": F.col("rsi") / 100, "p2": F.lit(1.5),
        "dynamic_weight": fn.dynamic_weight(strength, F.col("accuracy"), F.col("trend_strength"), F.col("volatility_p")),
    }
    trades = cycle.live_trades(bars, scores)
    store = cycle.trade_store(spark, new_path(spark, "trades"), trades)
    cycle.run_cycle(trades, store, new_path(spark, "checkpoint")).awaitTermination()
    return rounded(store.read(), 6, *cycle.TRADE[3:])


@query(
    "breaches_in_order",
    """WITH known AS (SELECT * FROM events WHERE date_trunc('milliseconds', ts) <=
        (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)),
    r AS (SELECT event_type AS symbol, ts::DATE::TIMESTAMP AS day, ts,
      sum((100 - value) / 1e4) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts) AS total,
      value / first_value(value) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts) - 1 AS move FROM known)
    SELECT symbol, day, 'stop' AS kind, min(ts) AS ts, round(arg_min(total, ts), 6) AS value FROM r WHERE -total >= 0.02 GROUP BY 1, 2
    UNION ALL
    SELECT symbol, day, 'pause', min(ts), round(arg_min(move, ts), 6) FROM r WHERE abs(move) > 0.1 GROUP BY 1, 2""",
)
def breaches_in_order(spark, sf):
    """Events up to eight minutes late, in eight batches."""
    arrival = F.col("ts") + F.make_dt_interval(mins=F.pmod(F.xxhash64("event_id"), F.lit(9)).cast("int"))
    hour = (F.dayofmonth(arrival) - 1) * 24 + F.hour(arrival)
    slot = F.when(F.month(arrival) > 1, 7).otherwise(F.least(F.floor(hour / 90), F.lit(7)))
    ticks = event_batches(spark, sf, slot, 8).select(
        F.col("event_type").alias("symbol"), "ts", ((100 - F.col("value")) / 1e4).alias("pnl"), F.col("value").alias("price")
    )
    with cycle.keyed_state(spark):
        found = live.run_to_table(live.breaches_in_order(ticks), "breaches")
    zone_free = {c: F.col(c).cast("timestamp_ntz") for c in ("day", "ts")}
    return rounded(found.withColumns(zone_free), 6, "value")
