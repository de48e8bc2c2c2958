"""Learners, calibration and the boards they feed. Fitted models have no SQL; what is arithmetic has."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import evaluate, models, splits, windows
from .registry import VIEWS, query

FEATURES = ["mean_ret", "vol", "drift", "band_z", "momentum", "rsi", "stoch_k"]


def _rows(d):
    f = d.windowed(windows.price13).join(d.windowed(windows.labelled).select("market_id", "bar_ts", "tfrac", "n"), ["market_id", "bar_ts"])
    return splits.out_of_time(f)


VIEWS["learned"] = "select feats.*, case when m < 5 or j < floor(m * 0.8::double) - 4 then 'train' when j >= floor(m * 0.8::double) then 'val' end as part from feats join anchor_rows using (market_id, bar_ts)"


def newton_sql(table: str, features: list[str], label: str, l2: float = 1e-3, steps: int = 6) -> str:
    """The same Newton steps as common table expressions: `w` has the last weights (w0 the intercept), `st` means and deviations.

    Each step's equations are solved column by column, without exchanges of rows: the matrix is positive definite.
    """
    n = len(features) + 1
    parts = [f"st as materialized (select {', '.join(f'avg({f}) as m{k}, stddev_samp({f}) as s{k}' for k, f in enumerate(features, 1))} from {table} where part = 'train')"]
    parts.append(f"x as materialized (select 1::double as x0, {label}::double as y, {', '.join(f'({f} - m{k}) / s{k} as x{k}' for k, f in enumerate(features, 1))} from {table}, st where part = 'train')")
    parts.append(f"w_0 as (select {', '.join(f'0::double as w{k}' for k in range(n))})")
    for step in range(steps):
        odds = " + ".join(f"w{k} * x{k}" for k in range(n))
        sums = [f"avg((p - y) * x{i}) + {l2 if i else 0}::double * any_value(w{i}) as a{i}_{n}" for i in range(n)]
        sums += [f"avg(p * (1 - p) * x{i} * x{j}) + {l2 if i == j and i else 0}::double as a{i}_{j}" for i in range(n) for j in range(n)]
        parts.append(f"e{step}_0 as materialized (select {', '.join(sums)} from (select *, 1 / (1 + exp(-({odds}))) as p from x, w_{step}))")
        for c in range(n):
            cells = [f"a{i}_{j}{'' if i == c else f' - a{i}_{c} * a{c}_{j} / a{c}_{c}'} as a{i}_{j}" for i in range(n) for j in range(c, n + 1)]
            cells += [f"a{i}_{i} as d{i}" if i == c else f"d{i}" for i in range(c + 1)]
            parts.append(f"e{step}_{c + 1} as materialized (select {', '.join(cells)} from e{step}_{c})")
        parts.append(f"w_{step + 1} as materialized (select {', '.join(f'w{i} - a{i}_{n} / d{i} as w{i}' for i in range(n))} from w_{step}, e{step}_{n})")
    parts.append(f"w as (select * from w_{steps})")
    return ", ".join(parts)


def odds_sql(features: list[str]) -> str:
    return "(w0 + " + " + ".join(f"w{k} * ({f} - m{k}) / s{k}" for k, f in enumerate(features, 1)) + ")"


def auc_sql(rows: str, score: str, label: str) -> str:
    up, down = f"count(*) filter (where {label} > 0.5)", f"count(*) filter (where {label} <= 0.5)"
    return f"(select (sum(k) filter (where {label} > 0.5) - {up} * ({up} + 1) / 2.0) / ({up} * {down}) from (select {label}, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as k from {rows}))"


_losses = """avg((prob - label) ** 2) as brier, avg(-(label * ln(greatest(1e-12, least(1 - 1e-12, prob))) + (1 - label) * ln(1 - greatest(1e-12, least(1 - 1e-12, prob))))) as log_loss, avg(((prob > 0.5) = (label > 0.5))::int) as accuracy,
  (coalesce(avg((prob > 0.5)::int) filter (where label > 0.5), 0) + coalesce(avg((prob <= 0.5)::int) filter (where label <= 0.5), 0)) / 2 as balanced_accuracy, count(*) as n"""
_logistic = f"""with {newton_sql("learned", FEATURES, "label")}, v as (select label, 1 / (1 + exp(-{odds_sql(FEATURES)})) as prob from learned, w, st where part = 'val')
select {_losses}, {auc_sql("(select label, round(prob, 9) as prob from v)", "prob", "label")} as auc from v"""


for _name, _fit, _sql in (("fit_logistic", models.fit_logistic, _logistic), ("fit_gbdt", models.fit_gbdt, None), ("fit_mlp", models.fit_mlp, None)):

    @query(_name, _sql, "brier log_loss accuracy balanced_accuracy auc")
    def _(d, fit=_fit):
        found = _rows(d).where("part is not null")
        rows = found.persist()
        model = fit(rows, FEATURES)
        rows.unpersist()
        scored = model(found.where("part = 'val'"))
        return evaluate.losses(scored, "prob", "label").crossJoin(evaluate.auc(scored.withColumn("prob", F.round("prob", 9)), "prob", "label"))


def _temperature_sql(low: float = 0.25, high: float = 6.0, passes: int = 4, points: int = 9) -> str:
    """Each pass is a grid over the interval that the pass before it left, the first of equal losses being the best."""
    parts = ["z as (select ln(q / (1 - q)) as z, outcome as y from (select greatest(1e-6, least(1 - 1e-6, flow)) as q, outcome from records))", f"i0 as (select {low}::double as low, {high}::double as high)"]
    for k in range(passes):
        parts.append(f"""l{k} as (select g, avg(ln(1 + exp(-abs(z / t))) + greatest(z / t, 0) - y * z / t) as loss from z, (select g, low + (high - low) * g / {points - 1} as t from i{k}, range({points}) r(g)) group by 1)""")
        parts.append(f"""i{k + 1} as (select low + (high - low) * greatest(0, b - 1) / {points - 1} as low, low + (high - low) * least({points - 1}, b + 1) / {points - 1} as high from i{k}, (select arg_min(g, (loss, g)) as b from l{k}))""")
    return f"with {', '.join(parts)} select (low + high) / 2 as temperature, (select count(*) from records) as n from i{passes}"


@query("fit_temperature", _temperature_sql(), "temperature", 4)
def _(d):
    t = models.fit_temperature(d.records, "flow")
    return d.records.agg(F.lit(t).alias("temperature"), F.count("*").alias("n"))


VIEWS["split60"] = "select *, round(prob, 3) as p3, row_number() over (order by ts, seq) - 1 < floor(count(*) over () * 0.6::double) as train from records"
#: Rising fit at each distinct score: the greatest, over all starts up to it, of the least mean of a stretch that holds it.
VIEWS["knots"] = "select row_number() over (order by p3) as i, p3, sum(y) over (order by p3) as s, sum(n) over (order by p3) as c, y, n from (select p3, sum(outcome) as y, count(*) as n from split60 where train group by 1)"
VIEWS["rising"] = """select i, any_value(p) as p3, max(m) as fit from (
  select j.i, j.p3 as p, min((j.s - a.s + a.y) / (j.c - a.c + a.n)) over (partition by a.i order by j.i desc) as m from knots a join knots j on j.i >= a.i) group by 1"""
VIEWS["applied"] = """select seq, prob, outcome, case when lo.fit is null then hi.fit when hi.fit is null or hi.p3 = lo.p3 then lo.fit else lo.fit + (hi.fit - lo.fit) * (x.p3 - lo.p3) / (hi.p3 - lo.p3) end as f
  from (select * from split60 where not train) x asof left join (select p3, fit from rising) lo on x.p3 >= lo.p3 asof left join (select p3, fit from rising) hi on x.p3 <= hi.p3"""


def _split60(d):
    return evaluate.by_time(d.records.withColumn("p3", F.round("prob", 3)), 0.6)


@query("isotonic_fit", """select avg((f - outcome) ** 2) as brier, count(*) as n from applied""", "brier")
def _(d):
    cut = _split60(d)
    fit = models.fit_isotonic(cut.where("train"), "p3")
    return evaluate.losses(fit(cut.where("not train")), "calibrated").select("brier", "n")


#: One calibration of each form, and one that names none: for each of the models that a record has.
CALIBRATIONS = {"map": [[0.1, 0.05], [0.3, 0.2], [0.5, 0.55], [0.5, 0.6], [0.8, 0.7], [0.95, 0.99]], "cooled": {"method": "temperature", "temperature": 1.5}, "platt": {"method": "platt", "a": 0.8, "b": -0.2}, "none": None}
_sig = lambda z: f"(1 / (1 + exp(-greatest(-60, least(60, {z})))))"


def _step_map_sql(p: str, points: list) -> str:
    parts = [f"when {p} <= {points[0][0]}::double then {points[0][1]}::double"]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        parts.append(f"when {p} <= {x1}::double then {y0}::double" + (f" + {y1 - y0}::double * ({p} - {x0}::double) / {x1 - x0}::double" if x1 - x0 >= 1e-12 else ""))
    return f"case {' '.join(parts)} else {points[-1][1]}::double end"


_forms = {"map": ("isotonic", _step_map_sql(_sig("z"), CALIBRATIONS["map"])), "cooled": ("temperature", _sig("z / 1.5::double")), "platt": ("platt", _sig("0.8::double * z - 0.2::double")), "none": ("sigmoid", _sig("z"))}


@query("calibrate_logit", "with l as (select seq, ln(q / (1 - q)) as z from (select seq, greatest(1e-6, least(1 - 1e-6, prob)) as q from records)) " + " union all ".join(f"select seq, '{n}' as name, '{k}' as kind, {e} as prob from l" for n, (k, e) in _forms.items()), "prob")
def _(d):
    from ..operators.ensemble import logit

    z = logit(F.col("prob"))
    forms = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(models.calibration_kind(c)).alias("kind"), models.calibrated(z, c).alias("prob")) for n, c in CALIBRATIONS.items()])
    return d.records.select("seq", F.explode(forms).alias("c")).select("seq", "c.*")


@query("best_threshold_bal_acc", """select threshold, (coalesce(avg(case when outcome > 0.5 then (prob >= threshold)::int end), 0) + coalesce(avg(case when outcome <= 0.5 then (prob < threshold)::int end), 0)) / 2 as balanced_accuracy
  from records, (select round(0.2 + 0.01 * k, 2)::double as threshold from range(61) r(k)) group by 1 order by round(balanced_accuracy, 12) desc, threshold limit 1""", "threshold balanced_accuracy")
def _(d):
    return models.threshold_by_balance(d.records)


@query("quantile_grid_p_up", """with m as (select market_id, price - lag(price) over (partition by market_id order by t, seq) as move from tape), g as (select market_id, quantile_cont(move, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from m where move is not null group by 1),
b as (select *, len([x for x in q if x <= 0]) as k from g)
select market_id, greatest(0.001, least(0.999, 1 - case when k = 0 then 0 when k = 9 then 1 else (k + case when q[k + 1] > q[k] then -q[k] / (q[k + 1] - q[k]) else 0 end) / 10 end)) as p_up from b""", "p_up")
def _(d):
    from pyspark.sql import Window as W

    move = F.col("price") - F.lag("price").over(W.partitionBy("market_id").orderBy("t", "seq"))
    return models.p_up(d.tape.select("market_id", move.alias("move")).where("move is not null"), "market_id", "move")


@query("embed_cosine", """with u as (select vec_id, label, [x / sqrt(list_sum([y::double * y::double for y in embedding])) for x in embedding::double[]] as u from embeddings),
g as (select list(m order by k) as g from (select k, avg(x) as m from (select unnest(u) as x, unnest(range(len(u))) as k from u where label = 0) group by 1))
select vec_id, list_dot_product(u, g) as cosine from u, g""", "cosine")
def _(d):
    return models.cosine_to_group(d.table("embeddings"), 0)


CANDIDATES = ["band_z", "momentum", "rsi", "stoch_k"]


@query("signal_eval", " union all ".join(f"""select '{f}' as feature, auc, abs(auc - 0.5) + 0.5 as strength, r from (select (sum(k) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0) / (count(*) filter (where label = 1) * count(*) filter (where label = 0)) as auc, coalesce(corr({f}, fwd), 0) as r
  from (select label, fwd, {f}, rank() over (order by round({f}, 9)) + (count(*) over (partition by round({f}, 9)) - 1) / 2.0 as k from feats))""" for f in CANDIDATES), "auc strength r", 5)
def _(d):
    rows = d.windowed(windows.price13)
    return models.auc_of(rows.select("label", "fwd", *[F.round(c, 9).alias(c) for c in CANDIDATES]), CANDIDATES)


VIEWS["model_records"] = "select r.seq, r.ts, p.model, p.prob, r.market_price, r.outcome from records r join preds_long p using (seq)"
_t = """select *, gross - 0.01 as net from (select *, abs(prob - market_price) as edge, case when prob > market_price then outcome - market_price else market_price - outcome end as gross from model_records where abs(prob - market_price) > 0.02)"""


@query("leaderboard", f"""with l as (select model, avg((prob - outcome) ** 2) as brier, count(*) as n from model_records group by 1),
t as (select model, count(*) as n_trades, sum(net) as pnl, case when stddev_pop(net) > 1e-12 then avg(net) / stddev_pop(net) else 0 end as sharpe from ({_t}) group by 1)
select row_number() over (order by -sharpe, brier, model) as rank, model, brier, n, n_trades, pnl, sharpe from l join t using (model)""", "brier pnl sharpe")
def _(d):
    from pyspark.sql import Window as W

    r = d.records.select("seq", "ts", "market_price", "outcome").join(d.preds_long.select("seq", "model", "prob"), "seq")
    l = evaluate.losses(r, "prob", "outcome", 1e-12, "model").select("model", "brier", "n")  # noqa: E741
    t = evaluate.results(evaluate.trades(r, 0.02), "model").select("model", "n_trades", "pnl", "sharpe")
    # a row a model: the order of so few is one small task
    return l.join(t, "model").select(F.row_number().over(W.orderBy(-F.col("sharpe"), "brier", "model")).alias("rank"), "model", "brier", "n", "n_trades", "pnl", "sharpe")


@query("reported_vs_reproduced", """select model, brier, reported, brier - reported as delta, coalesce(abs(brier - reported) > 0.05, false) as flagged from (select model, avg((prob - outcome) ** 2) as brier from model_records group by 1)
  left join (values ('resolve', 0.25::double), ('flow', 0.4)) v(model, reported) using (model)""", "brier reported delta")
def _(d):
    r = d.records.select("seq", "outcome").join(d.preds_long.select("seq", "model", "prob"), "seq")
    said = d.spark.createDataFrame([("resolve", 0.25), ("flow", 0.4)], "model string, reported double")
    m = evaluate.losses(r, "prob", "outcome", 1e-12, "model").select("model", "brier").join(said, "model", "left")
    delta = F.col("brier") - F.col("reported")
    return m.withColumns({"delta": delta, "flagged": F.coalesce(F.abs(delta) > 0.05, F.lit(False))})


_shares = [sum(2.718281828459045**-1 / math.factorial(k) for k in range(j + 1)) for j in range(7)]
_u = f"((x * x % {models.PRIME} + 0.5) / {models.PRIME}::double)"


@query("bootstrap_ci", f"""with t as (select seq, case when prob > market_price then outcome - market_price else market_price - outcome end - 0.01 as net from records where abs(prob - market_price) > 0.02),
h as (select net, b, ((seq % {models.PRIME} * 48271 + b * 69621 + 11) % {models.PRIME}) as x from t, range(2000) r(b)), i as (select net, b, (x * x % {models.PRIME} * 16807 + b) % {models.PRIME} as x from h),
k as (select b, sum(w * net) / sum(w) as m from (select net, b, {" + ".join(f"({_u} > {c!r}::double)::int" for c in _shares)} as w from i) group by 1)
select l[51] as low, l[1951] as high, mean from (select list(m order by m) as l, avg(m) as mean from k)""", "low high mean")
def _(d):
    return models.bootstrap_mean(evaluate.trades(d.records, 0.02), "net", "seq")


_fuzzy = "select p_partkey, p_name, lower(p_name) as low, 0 as at0, 0::double as t0, -1 as b0 from part"
for _k, _ch in enumerate("art"):
    _fuzzy = f"""select *, k{_k} + 1 as at{_k + 1}, t{_k} + case when k{_k} = 0 then 12 when not regexp_matches(substr(low, k{_k}, 1), '[\\p{{L}}\\p{{N}}]') then 9 when b{_k} >= 0 and k{_k} = b{_k} + 1 then 6 else 1 end - case when b{_k} >= 0 then 0.4::double * (k{_k} - at{_k}) else 0 end as t{_k + 1}, k{_k} as b{_k + 1}
  from (select *, at{_k} + strpos(substr(low, (at{_k} + 1)::int), '{_ch}') - 1 as k{_k} from ({_fuzzy}) where strpos(substr(low, (at{_k} + 1)::int), '{_ch}') > 0)"""


@query("fuzzy_topk", f"select p_partkey, p_name, t3 + (20 - length(p_name)) * 0.15::double as score from ({_fuzzy}) order by round(score, 9) desc, p_name, p_partkey limit 24", "score")
def _(d):
    return models.fuzzy_top(d.table("part").select("p_partkey", "p_name"), "p_name", "art")


@query("scan_by_conviction", "select market_id, prob, 2 * abs(prob - 0.5) as conviction, case when prob > 0.5 then 'up' else 'down' end as direction from (select market_id, arg_max(resolve, t) as prob from preds group by 1) order by round(conviction, 9) desc, market_id limit 20", "prob conviction")
def _(d):
    p = d.preds.groupBy("market_id").agg(F.max_by("resolve", "t").alias("prob")).withColumn("conviction", 2 * F.abs(F.col("prob") - 0.5))
    return p.withColumn("direction", F.when(F.col("prob") > 0.5, "up").otherwise("down")).orderBy(F.desc(F.round("conviction", 9)), "market_id").limit(20)


@query("scan_by_mispricing", """select *, case when abs(edge) < 0.02 then 'fair' when edge > 0 then 'cheap' else 'rich' end as verdict, least(1, abs(edge) / 0.15 * (0.5 + 0.5 * conviction)) as confidence from (
  select market_id, prob - price as edge, 2 * abs(prob - 0.5) as conviction from (select market_id, arg_max(resolve, t) as prob, arg_max(price, t) as price from preds group by 1)) order by round(abs(edge), 9) desc, market_id limit 20""", "edge conviction confidence")
def _(d):
    p = d.preds.groupBy("market_id").agg(F.max_by("resolve", "t").alias("prob"), F.max_by("price", "t").alias("price"))
    p = p.select("market_id", (F.col("prob") - F.col("price")).alias("edge"), (2 * F.abs(F.col("prob") - 0.5)).alias("conviction"))
    verdict = F.when(F.abs("edge") < 0.02, "fair").when(F.col("edge") > 0, "cheap").otherwise("rich")
    p = p.withColumns({"verdict": verdict, "confidence": F.least(F.lit(1.0), F.abs("edge") / 0.15 * (0.5 + 0.5 * F.col("conviction")))})
    return p.orderBy(F.desc(F.round(F.abs("edge"), 9)), "market_id").limit(20)


@query("scan_by_risk_adjusted", "select seq, edge, confidence, abs(edge * confidence) as strength from decided order by round(abs(edge * confidence), 9) desc, seq limit 20", "edge confidence strength")
def _(d):
    from .evaluation_queries import decided

    s = decided(d).select("seq", "edge", "confidence", F.abs(F.col("edge") * F.col("confidence")).alias("strength"))
    return s.orderBy(F.desc(F.round("strength", 9)), "seq").limit(20)


@query("momentum_diagnostic", "select (sum(k) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0) / (count(*) filter (where label = 1) * count(*) filter (where label = 0)) as auc from (select label, rank() over (order by round(momentum, 9)) + (count(*) over (partition by round(momentum, 9)) - 1) / 2.0 as k from feats)", "auc", 5)
def _(d):
    return evaluate.auc(d.windowed(windows.price13).select("label", F.round("momentum", 9).alias("momentum")), "momentum", "label")


