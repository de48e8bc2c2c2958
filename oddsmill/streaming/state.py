"""Stateful processors: what a live feed keeps for each key. Rows of a batch are taken in the order of `seq`.

A processor takes the rows of its key as one frame, works on its columns, and touches the state once for what changed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Processors travel with their code: the runner of a stream on the driver has no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ticks of a full window.
TICKS = 16


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("seq", kind="stable", ignore_index=True)


class Book(StatefulProcessor):
    """Levels and quote of one token, from one feed of snapshots and deltas.

    A snapshot row replaces the book; a delta sets a level of a book that a snapshot has made, size 0 deletes it. A delta
    before the first snapshot makes no book. Every delta moves its side's quote, a snapshot does where it has size.
    Two outputs, told apart by `kind`: the whole book of each touched token as `level` rows, and one `quote` row.
    """

    OUT = "token long, kind string, side string, price double, size double, bid double, ask double, seq long"
    COLUMNS = ["token", "kind", "side", "price", "size", "bid", "ask", "seq"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.open = handle.getValueState("open", "since long")
        self.quote = handle.getValueState("quote", "bid double, ask double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        r = _in_order(rows)
        seq = int(r["seq"].iloc[-1])
        snapshots = np.flatnonzero(r["kind"].to_numpy() == "snapshot")
        bid, ask = self.quote.get() if self.quote.exists() else (None, None)
        touched = r[(r["kind"] != "snapshot") | (r["size"] > 0)].groupby("side")["price"].last()
        bid, ask = (float(touched[s]) if s in touched else old for s, old in (("bid", bid), ("ask", ask)))
        self.quote.update((bid, ask))
        if len(snapshots):
            self.levels.clear()
            self.open.update((int(r["seq"].iloc[snapshots[-1]]),))
            r = r.iloc[snapshots[-1] :]
        book = []
        if self.open.exists():
            for side, price, size in r.drop_duplicates(["side", "price"], keep="last")[["side", "price", "size"]].itertuples(index=False):
                if size > 0:
                    self.levels.updateValue((side, float(price)), (float(size),))
                elif self.levels.exists() and self.levels.containsKey((side, float(price))):
                    self.levels.removeKey((side, float(price)))
            book = [(key[0], "level", k[0], k[1], v[0], None, None, seq) for k, v in self.levels.iterator()] if self.levels.exists() else []
        yield pd.DataFrame([*book, (key[0], "quote", None, None, None, bid, ask, seq)], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class Quote(StatefulProcessor):
    """The last known price of one market and the direction of its last change."""

    OUT = "market_id long, price double, tick int, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double, tick int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, tick = self.last.get() if self.last.exists() else (None, 0)
        r = _in_order(rows)
        prices = r["price"].to_numpy(float)
        way = np.concatenate([[] if before is None else [before], prices])[-2:]
        if len(way) == 2:
            tick = int(way[1] > way[0]) - int(way[1] < way[0])
        self.last.update((float(prices[-1]), tick))
        yield pd.DataFrame([(key[0], prices[-1], tick, int(r["seq"].iloc[-1]))], columns=["market_id", "price", "tick", "seq"])

    def close(self) -> None:
        pass


class Crossing(StatefulProcessor):
    """Alerts of one market. Rows are `arm` (with op and target), `disarm` and `tick`.

    An armed alert fires when a price crosses its target; the first price after arming only sets the side it comes
    from. Firing or disarming drops the state, so an alert that is armed again starts without a price; arming an armed
    one does so too.
    """

    OUT = "market_id long, op string, target double, price double, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.armed = handle.getValueState("armed", "op string, target double, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        r = _in_order(rows)
        op, target, before = self.armed.get() if self.armed.exists() else (None, None, None)
        control = r["kind"].to_numpy() != "tick"
        r["session"] = np.cumsum(control)
        starts = r[control]
        # what holds in each session; the one before the first control row is carried from the state
        ops = [op, *starts["op"].where(starts["kind"] == "arm", None)]
        targets = [target, *starts["target"].where(starts["kind"] == "arm", None)]
        ticks = r[~control].copy()
        ticks["before"] = ticks.groupby("session")["price"].shift()
        if before is not None and len(ticks) and ticks["session"].iloc[0] == 0:
            ticks.loc[ticks.index[0], "before"] = before
        ticks["op"], ticks["target"] = [ops[s] for s in ticks["session"]], [targets[s] for s in ticks["session"]]
        goal, price, old = ticks["target"].astype(float), ticks["price"], ticks["before"]
        up, down = (ticks["op"] == "gte") & (old < goal) & (price >= goal), (ticks["op"] == "lte") & (old > goal) & (price <= goal)
        fired = ticks[up | down].drop_duplicates("session")
        last = len(ops) - 1
        if ops[last] is None or (fired["session"] == last).any():
            self.armed.clear()
        else:
            own = ticks.loc[ticks["session"] == last, "price"]
            price = float(own.iloc[-1]) if len(own) else before if last == 0 else None
            self.armed.update((ops[last], float(targets[last]), price))
        if len(fired):
            out = fired[["op", "target", "price", "seq"]].astype({"target": float})
            out.insert(0, "market_id", key[0])
            yield out

    def close(self) -> None:
        pass


class Rolling(StatefulProcessor):
    """The last 16 prices of one market; a price equal to the one before isn't a tick.

    The window is a ring: a tick overwrites the slot of the one that leaves, the others aren't written again.
    """

    OUT = "market_id long, prices array<double>, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "price double")
        self.seen = handle.getValueState("seen", "ticks long, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        r = _in_order(rows)
        ticks, last = self.seen.get() if self.seen.exists() else (0, None)
        prices = r["price"].to_numpy(float)
        moved = np.concatenate([[last is None or prices[0] != last], prices[1:] != prices[:-1]])
        new = prices[moved]
        first = ticks + max(0, len(new) - TICKS)
        for k, p in enumerate(new[-TICKS:].tolist()):
            self.slots.updateValue(((first + k) % TICKS,), (p,))
        ticks += len(new)
        self.seen.update((ticks, float(prices[-1])))
        held = {k[0]: v[0] for k, v in self.slots.iterator()}
        window = [held[k % TICKS] for k in range(max(0, ticks - TICKS), ticks)]
        yield pd.DataFrame({"market_id": [key[0]], "prices": pd.Series([window], dtype=object), "seq": [int(r["seq"].iloc[-1])]})

    def close(self) -> None:
        pass


class PeerLatest(StatefulProcessor):
    """The newest message of one peer, until it is `lifetime` seconds old by the stream's own time.

    Only a strictly later message replaces the held one (the first of equals stays). A timer in event time drops
    the peer when the watermark has passed its message by more than the lifetime, and a row without a market says so;
    a message that is too old when it comes is ignored.
    """

    OUT = "peer string, ts double, market_id long, prob double, seq long, alive boolean"
    COLUMNS = ["peer", "ts", "market_id", "prob", "seq", "alive"]

    def __init__(self, lifetime: float = 45.0):
        self.ttl = int(lifetime * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ts double, market_id long, prob double, seq long")

    def _expiry(self, ts: float) -> int:
        return int(np.floor(ts * 1000 + 1e-6)) + self.ttl + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        r = _in_order(rows)
        held = self.latest.get() if self.latest.exists() else None
        best = r.loc[r["ts"].idxmax()]  # the first of equals: rows are in order
        if (held is None or best.ts > held[0]) and self._expiry(best.ts) > timerValues.getCurrentWatermarkInMs():
            if held is not None:
                self.handle.deleteTimer(self._expiry(held[0]))
            now = (float(best.ts), int(best.market_id), float(best.prob), int(best.seq))
            self.latest.update(now)
            self.handle.registerTimer(self._expiry(now[0]))
            yield pd.DataFrame([(key[0], *now, True)], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.latest.exists():
            ts, _, _, seq = self.latest.get()
            self.latest.clear()
            out = pd.DataFrame([(key[0], ts, None, None, seq, False)], columns=self.COLUMNS)
            yield out.astype({"market_id": "Int64", "prob": "float64"})

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, key: str, processor: StatefulProcessor, time: str = "None") -> DataFrame:
    """Runs a processor for each key; state lives in RocksDB, so it isn't bounded by memory. `time` is None or EventTime."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Update", timeMode=time)


def peers(messages: DataFrame, me: str, lifetime: float = 45.0) -> DataFrame:
    """Changes of the newest message of each peer but oneself; messages have peer, ts (seconds), at (their timestamp)."""
    others = messages.where(F.col("peer") != me).withWatermark("at", "0 seconds")
    return stateful(others, "peer", PeerLatest(lifetime), "EventTime")


def run(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs a stream over all that is there. `write` gets each batch and its number, and must be the same when repeated."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def drain(stream: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, each row with its batch.

    A batch has a folder of its own by its number, so one that runs again after a failure replaces what it wrote.
    """
    run(stream, path, lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}"), mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return stream.sparkSession.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out")


def newest(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of each key's last batch."""
    last = df.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return df.join(last, [*keys, "batch"]).drop("batch")


def live_bars(tape: DataFrame, seconds: int, delay: str, whale: float, key: str = "market_id") -> DataFrame:
    """Bars of a stream with everything that bars of a table have, as updates of the bars that changed.

    tape has ts (timestamp), t, seq, price, usd, side. Open and close are those of least and greatest (t, seq), so rows may
    come in any order within the watermark's delay.
    """
    usd, buy, at = F.col("usd"), F.col("side") == "BUY", F.struct("t", "seq")
    b = tape.withWatermark("ts", delay).groupBy(key, F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("usd").alias("volume"), F.count("*").alias("trades"),
        F.sum(F.when(buy, usd).otherwise(-usd)).alias("signed_vol"), F.sum(F.when(buy, usd).otherwise(0.0)).alias("buy_vol"), F.sum(F.when(buy, 0.0).otherwise(usd)).alias("sell_vol"), F.sum(F.when(usd >= whale, usd).otherwise(0.0)).alias("whale_vol"),
    )
    return b.select(key, F.expr("timestampdiff(SECOND, timestamp'1970-01-01 00:00:00', w.start)").alias("bar_ts"), *[c for c in b.columns if c not in (key, "w")])


def consensus(latest: DataFrame, now: float, lifetime: float = 45.0) -> DataFrame:
    """Votes of the peers whose newest message hasn't expired: neutral peers count in the mean and not in the votes."""
    live = latest.where(F.col("ts") > now - lifetime)
    up, down = F.count_if(F.col("prob") > 0.5), F.count_if(F.col("prob") < 0.5)
    g = live.groupBy("market_id").agg(up.alias("bulls"), down.alias("bears"), F.count("*").alias("voters"), F.avg("prob").alias("mean_prob"))
    votes = F.col("bulls") + F.col("bears")
    return g.withColumn("agreement", F.when(votes > 0, (F.col("bulls") - F.col("bears")) / votes).otherwise(0.0))
