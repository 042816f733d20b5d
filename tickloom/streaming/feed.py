"""Packets of the exchange's feed as ticks; the same plan for a table and for a stream joined to a table of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ticks

LEVEL = "array<struct<price: string, quantity: bigint, num_orders: bigint, orders: bigint>>"
#: The feed's own names. What a packet may hold, as JSON; prices in hundredths, as text, for some are malformed.
PACKET = f"token string, sequence_number bigint, last_traded_price string, last_traded_quantity bigint, average_traded_price string, average_trade_price string, volume_trade_for_the_day bigint, total_buy_quantity bigint, total_sell_quantity bigint, open_price_of_the_day string, high_price_of_the_day string, low_price_of_the_day string, closed_price string, open_interest bigint, exchange_timestamp string, last_traded_timestamp string, best_5_buy_data {LEVEL}, best_5_sell_data {LEVEL}"
#: The feed's codes of the exchanges.
EXCHANGES = {"NSE": 1, "NFO": 2, "BSE": 3, "BFO": 4, "MCX": 5}


def packets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of JSON as packets and received (the line's own clock, if it has one); a line that is no JSON has only nulls. Lines
    are laid out by `inline`: no filter or projection on a packet's fields moves below it, so each line is parsed once."""
    received = F.col("received") if "received" in lines.columns else F.lit(None).cast("timestamp_ntz")
    return lines.select(F.inline(F.array(F.from_json(column, PACKET))), received.alias("received"))


def units(hundredths: Column) -> Column:
    """A price in hundredths as units; null if it is no number."""
    return F.nanvl(hundredths.try_cast("double"), F.lit(None).cast("double")) / 100


def best_five(levels: Column) -> Column:
    """Levels with a price, as price, quantity and orders; null if there are none."""
    good = F.filter(F.transform(levels, lambda x: F.struct(units(x["price"]).alias("price"), x["quantity"].alias("quantity"), F.coalesce(F.when(x["num_orders"] != 0, x["num_orders"]), x["orders"]).alias("orders"))), lambda x: x["price"].isNotNull())
    return F.when(F.size(good) > 0, good)


def clock(cell: Column) -> Column:
    """A clock's count as a whole number; null if it isn't a positive number that a time can have."""
    n = cell.try_cast("double")
    return F.when((n > 0) & (n < 1e14), F.floor(n))


def parsed(packets: DataFrame, tokens: DataFrame) -> DataFrame:
    """packets as ticks of the instruments in tokens (token, instrument; one row a token). Unknown tokens and packets without a
    positive price are dropped. timestamp is the first usable clock and time_source says which; without one it is `received`."""
    p = packets.withColumn("ltp", units(F.col("last_traded_price"))).where("ltp > 0").join(tokens.select("token", "instrument"), "token")
    at = ticks.event_time(clock(F.col("exchange_timestamp")), clock(F.col("last_traded_timestamp")), F.col("received"))
    day = {"open": "open_price_of_the_day", "high": "high_price_of_the_day", "low": "low_price_of_the_day", "close": "closed_price"}
    # laid out by inline: what is asked of the time later doesn't repeat how it was chosen
    return p.select("*", F.inline(F.array(F.struct(at.alias("at"))))).select(
        "instrument", F.col("at.time").alias("timestamp"), F.coalesce("sequence_number", F.lit(0)).cast("bigint").alias("sequence_number"), "ltp", F.col("last_traded_quantity").alias("ltq"), *[units(F.col(c)).alias(k) for k, c in day.items()],
        units(F.coalesce("average_traded_price", "average_trade_price")).alias("avg_trade_price"), F.col("volume_trade_for_the_day").alias("volume"), F.col("total_buy_quantity").alias("total_buy_qty"), F.col("total_sell_quantity").alias("total_sell_qty"), "open_interest",
        best_five(F.col("best_5_buy_data")).alias("best_5_buy"), best_five(F.col("best_5_sell_data")).alias("best_5_sell"), F.col("at.source").alias("time_source"),
    )


def sources(ticks: DataFrame) -> DataFrame:
    """How many ticks each clock timed."""
    return ticks.groupBy("time_source").agg(F.count(F.lit(1)).alias("n"))


def active(instruments: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The active instruments of these types."""
    return instruments.where(F.col("instrument_type").isin(*kinds) & F.col("is_active"))


def subscriptions(instruments: DataFrame, limit: int = 1000) -> DataFrame:
    """exchange_type and its tokens, sorted, of the first `limit` instruments (the feed's own bound) by type and symbol; unknown exchanges are dropped."""
    code = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])[F.col("exchange")]
    some = instruments.withColumn("exchange_type", code).where("exchange_type IS NOT NULL").orderBy("instrument_type", "symbol", "token").limit(limit)
    return some.groupBy("exchange_type").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
