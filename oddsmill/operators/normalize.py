"""Normal forms of raw feeds, and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite_or, json_strings


def market(raw: DataFrame) -> DataFrame:
    """One row a market from feed fields that may be numbers or text, arrays or JSON text.

    Missing outcomes give an empty list; `last` is the last trade's price, else the first outcome's; changes come in
    points; active is only true when said so, accepting only false when said so.
    """
    labels, prices, tokens = (json_strings(c) for c in ("outcomes", "outcomePrices", "clobTokenIds"))
    d = raw.withColumn("outcomes", F.transform(F.arrays_zip(labels.alias("label"), prices.alias("price"), tokens.alias("token")), lambda x: F.struct(x["label"].alias("label"), finite_or(x["price"]).alias("price"), x["token"].alias("token_id"))))
    first = F.get("outcomes", 0)["price"]
    return d.select(
        F.col("id").cast("string").alias("id"), F.coalesce("question", F.lit("")).alias("question"), "outcomes",
        F.coalesce(F.col("lastTradePrice").try_cast("double"), first, F.lit(0.0)).alias("last"),
        (finite_or("oneDayPriceChange") * 100).alias("chg24h"),
        F.coalesce(F.col("volumeNum").try_cast("double"), F.col("volume").try_cast("double"), F.lit(0.0)).alias("volume"),
        finite_or("volume24hr").alias("volume24h"),
        F.coalesce(F.col("active"), F.lit(False)).alias("active"), F.coalesce(F.col("acceptingOrders"), F.lit(True)).alias("accepting"),
    )


def legs(events: DataFrame) -> DataFrame:
    """Markets of each event as rows that carry the event and its tags; markets without outcomes are dropped."""
    e = events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.explode("markets").alias("m"))
    return e.select("event_id", "event_title", "tags", "m.*").where(F.size("outcomes") > 0)


def book(levels: DataFrame) -> DataFrame:
    """Levels with their rank from the best: bids from above, asks from below; empty or malformed levels are dropped."""
    good = levels.select("token", "side", F.col("price").try_cast("double").alias("price"), F.col("size").try_cast("double").alias("size")).where("price is not null and size > 0")
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return good.withColumn("level", F.row_number().over(W.partitionBy("token", "side").orderBy(best)))


def trade(raw: DataFrame) -> DataFrame:
    """Trades with an id made of hash and asset where none is given, side BUY unless it says SELL, and a name."""
    return raw.select(
        F.coalesce("id", F.concat_ws("-", "hash", "asset")).alias("id"), "wallet", F.when(F.upper("side") == "SELL", "SELL").otherwise("BUY").alias("side"),
        F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("wallet")).alias("name"), finite_or("size").alias("size"), finite_or("price").alias("price"), "timestamp",
    )


def units(x: str, scale: float = 1e6) -> Column:
    """Decimal text of a whole number of millionths."""
    return F.col(x).try_cast("decimal(38,0)").cast("double") / scale


def fills(raw: DataFrame, cash: tuple[str, ...] = ("0",), least: float = 1e-6) -> DataFrame:
    """Fills as price, size, cash and the taker's direction; fills with both legs or none in cash, or dust, are dropped."""
    maker_cash, taker_cash = F.col("maker_asset_id").isin(*cash), F.col("taker_asset_id").isin(*cash)
    d = raw.where(maker_cash != taker_cash).select(
        "timestamp", "maker", "taker", F.when(taker_cash, F.col("maker_asset_id")).otherwise(F.col("taker_asset_id")).alias("token"),
        F.when(taker_cash, units("taker_amount_filled")).otherwise(units("maker_amount_filled")).alias("usd"),
        F.when(taker_cash, units("maker_amount_filled")).otherwise(units("taker_amount_filled")).alias("tokens"),
        F.when(taker_cash, 1).otherwise(-1).alias("direction"),
        (F.coalesce(units("protocol_fee"), F.lit(0.0)) + F.coalesce(units("taker_fee"), F.lit(0.0))).alias("fee"),
    )
    return d.where((F.col("usd") > least) & (F.col("tokens") > least)).withColumn("price", F.col("usd") / F.col("tokens"))


def yes_view(tape: DataFrame) -> DataFrame:
    """Prices and flow as seen from YES: a NO trade at p is one at 1 - p the other way."""
    yes = F.col("outcome_index") == 0
    return tape.withColumns({"yes_price": F.when(yes, F.col("price")).otherwise(1 - F.col("price")), "yes_flow": F.when((F.col("side") == "BUY") == yes, F.col("usd")).otherwise(-F.col("usd"))})


def valid_trades(tape: DataFrame) -> DataFrame:
    return tape.where("price > 0 and price < 1 and usd > 0 and not isnan(usd) and usd < double('infinity')")


def end_time(x: str) -> Column:
    """Seconds since 1970 from a number, an ISO time or a plain date; null where none fits."""
    c = F.col(x)
    number = c.try_cast("double")
    text = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")])
    return F.coalesce(number, F.unix_timestamp(text).cast("double"))


def busiest(tape: DataFrame, k: int, key: str = "market_id") -> DataFrame:
    """Trades of the k most traded keys, ties by key. The kept keys are k rows."""
    keep = tape.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k).select(key)
    return tape.join(keep, key, "left_semi")


def top_volume(markets: DataFrame, k: int) -> DataFrame:
    from ..functions.scalars import outcome_label

    ok = outcome_label("outcome_prices", "max_90_min_10").isNotNull() & (F.col("end") > F.col("created"))
    return markets.where(ok).orderBy(F.desc("volume"), "market_id").limit(k)


def min_history(df: DataFrame, least: int, key: str = "market_id") -> DataFrame:
    """Rows of keys that have `least` rows or more: counted first, then joined, so that only counts are shuffled twice."""
    keep = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    return df.join(keep, key, "left_semi")


def shared_signals(messages: DataFrame, version: int = 1, most: int = 200) -> DataFrame:
    """Signals of well-formed peer messages: bad entries go, the message stays; text is cut, numbers are clamped."""
    from ..functions.scalars import clamp

    ok = messages.where((F.col("v") == version) & F.length("peer").between(1, 96))
    s = ok.select("peer", "ts", F.explode(F.slice("signals", 1, most)).alias("s")).where("s.market_id is not null and s.prob is not null and not isnan(s.prob)")
    return s.select("peer", "ts", F.col("s.market_id").alias("market_id"), F.substring("s.question", 1, 160).alias("question"), clamp(F.col("s.prob"), 0, 1).alias("prob"), clamp(F.coalesce("s.heat", F.lit(0.0)), 0, 100).alias("heat"))


def checked_records(records: DataFrame) -> DataFrame:
    """Backtest records, or an error on the first that isn't finite."""
    bad = F.greatest(*[F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0) for c in ("prob", "market_price", "outcome")]) == 1
    return records.withColumn("prob", F.when(bad, F.raise_error(F.lit("a record isn't finite"))).otherwise(F.col("prob")))
