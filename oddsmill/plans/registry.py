"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.driver_tables import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: SQL of the domain's views, in order: later ones may use earlier ones.
VIEWS: dict[str, str] = {
    "tape": """select event_id as seq, user_id as market_id, user_id // 5 as basket_id, epoch(ts) as t, value / (value + 50) as price,
        value * 100 as usd, case when event_type in ('purchase', 'signup', 'click') then 'BUY' else 'SELL' end as side,
        case when event_type in ('signup', 'error') then 1 else 0 end as outcome_index, 'w' || (props ->> '$.k') as wallet,
        case when event_id % 5 < 2 then 'maker' else 'taker' end as role,
        case when event_type in ('purchase', 'signup', 'click') then 1 else -1 end * (value * 100) / nullif(value / (value + 50), 0) as token_amount from events""",
    "market": """select market_id, basket_id, last, volume24h, volume1w, volume, created, 100 * (last - coalesce(before, last)) as chg24h,
        newest + 86400 as "end", case when last > 0.5 then '[''1'', ''0'']' else '[''0'', ''1'']' end as outcome_prices,
        true as accepting, basket_id % 4 <> 3 as neg_risk from (
        select market_id, basket_id, arg_max(price, seq) as last, arg_max(price, seq) filter (where t <= now - 86400) as before,
        sum(case when t > now - 86400 then usd else 0 end) as volume24h, sum(case when t > now - 7 * 86400 then usd else 0 end) as volume1w,
        sum(usd) as volume, min(t) as created, max(t) as newest
        from tape, (select max(t) as now from tape) group by all)""",
    "quote": """select * exclude (q), q * (1 + (basket_id % 7 - 3) * 0.01) - 0.001 * (1 + market_id % 4) as best_bid,
        q * (1 + (basket_id % 7 - 3) * 0.01) + 0.001 * (1 + market_id % 4) as best_ask, volume as liquidity
        from (select *, last / nullif(sum(last) over (partition by basket_id), 0) as q from market)""",
    "book": """select token, side, price, sum(l_quantity) as size from (select l_suppkey as token,
        case when l_linestatus = 'O' then 'bid' else 'ask' end as side, l_quantity,
        round(case when l_linestatus = 'O' then 0.2::double + 0.1::double * (l_suppkey % 7) - 0.005::double - l_discount * 0.5
          else 0.2::double + 0.1::double * (l_suppkey % 7) + 0.005::double + l_tax * 0.5 end, 4) as price from lineitem) group by all""",
    "bars": """select market_id, (floor(t / 21600) * 21600)::bigint as bar_ts, arg_min(price, t) as open, max(price) as high, min(price) as low,
        arg_max(price, t) as close, sum(usd) as volume, count(*) as trades,
        sum(case when side = 'BUY' then usd else -usd end) as signed_vol, sum(case when side = 'BUY' then usd else 0 end) as buy_vol,
        sum(case when side = 'BUY' then 0 else usd end) as sell_vol, sum(case when usd >= 1000 then usd else 0 end) as whale_vol
        from tape group by 1, 2""",
    "preds": """select seq, market_id, t, price, avg(price) over w as resolve,
        0.5 + 0.4 * (sum(case when side = 'BUY' then usd else -usd end) over w) / nullif(sum(usd) over w, 0) as flow,
        case when seq % 10 <> 0 then (seq * 7919 % 1000) / 1000 end as smart
        from tape window w as (partition by market_id order by t, seq rows between 15 preceding and current row)""",
    "preds_long": """select seq, market_id, t, price, model, prob from (
        select seq, market_id, t, price, 'resolve' as model, resolve as prob from preds
        union all select seq, market_id, t, price, 'flow', flow from preds
        union all select seq, market_id, t, price, 'smart', smart from preds) where prob is not null""",
    "records": """select seq, market_id, t as ts, resolve as prob, price as market_price, case when later > price then 1.0 else 0.0 end::double as outcome,
        later - price as fwd, smart, flow
        from (select *, lead(price, 4) over (partition by market_id order by t, seq) as later from preds) where later is not null""",
    "positions": """select wallet, market_id, sum(token_amount) as size, sum(usd) / nullif(sum(abs(token_amount)), 0) as avg, any_value(last) as cur
        from tape join market using (market_id) group by 1, 2""",
    "alerts": "select market_id, avg(price) as target, case when market_id % 2 = 0 then 'gte' else 'lte' end as op from tape group by 1",
}


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Registers a query over a Domain. Doubles are rounded at the end, in Spark and in the SQL alike."""

    def add(f: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Domain(spark, sf_dir))
            return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql is not None:
            needed, text = [], sql
            for k in reversed(VIEWS):
                if re.search(rf"\b{k}\b", text):
                    needed.insert(0, k)
                    text += " " + VIEWS[k]
            views = ", ".join(f"{k} as ({VIEWS[k]})" for k in needed)
            replace = ", ".join(f"round({c}, {digits})::double + 0.0 as {c}" for c in doubles.split())
            SQL[name] = f"{f'with {views} ' if views else ''}select *{f' replace ({replace})' if replace else ''} from ({sql})"
        return f

    return add
