"""Studies of trades: what they came to, equity curves and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def study(trades: DataFrame, by: str) -> DataFrame:
    """Trades, share of wins, net result and profit factor (null without losses) for each value of `by`."""
    wins, losses = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0)), -F.sum(F.when(F.col("pnl") <= 0, F.col("pnl")).otherwise(0))
    return trades.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)), 2).alias("win_pct"), F.round(F.sum("pnl"), 4).alias("net"), F.round(F.try_divide(wins, losses), 4).alias("profit_factor"))


def equity(trades: DataFrame, capital: int) -> DataFrame:
    """strategy, day, equity (after the day's last trade), peak (never below capital) and drawdown in percent.

    Trades are summed by day first, so the running sums are over a strategy's days, not its trades.
    """
    days = trades.groupBy("strategy", F.to_date("entry_time").alias("day")).agg(F.sum("pnl").alias("pnl"))
    run = days.withColumn("equity", F.lit(capital) + F.expr("sum(pnl) OVER (PARTITION BY strategy ORDER BY day)"))
    peak = run.withColumn("peak", F.greatest(F.lit(capital).cast("bigint"), F.expr("max(equity) OVER (PARTITION BY strategy ORDER BY day)")))
    return peak.select("strategy", "day", "equity", "peak", F.round((F.col("peak") - F.col("equity")) / F.col("peak") * 100, 6).alias("drawdown_pct"))


def metrics(trades: DataFrame, capital: int) -> DataFrame:
    """By strategy: trades, wins, losses (no gain), share of wins, total, capital at the end, largest drawdown, and the Sharpe ratio
    of daily changes (0 if they don't vary). Trades without a result are no wins or losses."""
    curve = equity(trades, capital)
    change = curve.withColumn("front", F.expr("lag(equity) OVER (PARTITION BY strategy ORDER BY day)")).where("front > 0").withColumn("r", F.col("equity") / F.col("front") - 1)
    sharpe = change.groupBy("strategy").agg(F.round(F.when(F.stddev_pop("r") > 0, (F.avg("r") - 0.065 / 252) / F.stddev_pop("r") * F.sqrt(F.lit(252.0))).otherwise(0.0), 4).alias("sharpe"))
    worst = curve.groupBy("strategy").agg(F.max("drawdown_pct").alias("max_drawdown_pct"))
    n, wins, total = F.count(F.lit(1)), F.count_if(F.col("pnl") > 0), F.sum("pnl")
    sums = trades.groupBy("strategy").agg(
        n.alias("n"), wins.alias("wins"), F.count_if(F.col("pnl") <= 0).alias("losses"), F.round(100.0 * wins / n, 2).alias("win_pct"),
        total.alias("total"), (F.lit(capital) + F.coalesce(total, F.lit(0))).cast("bigint").alias("ending"),
    )
    return sums.join(worst, "strategy").join(sharpe, "strategy", "left")
