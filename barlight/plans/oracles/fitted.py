"""Statements that score from the stored parameter tables and measure how far they are from an optimum."""

from __future__ import annotations

from barlight.operators.candles import WEIGHT_FLAGS
from barlight.operators.stoprisk import TARGETS
from barlight.plans.oracles import cte, learn, oracle, r, score  # noqa: F401 - their expressions come first
from barlight.plans.oracles.parameters import SHORT, T, calibrated, inputs, raw

K = score.K

cte("q_short", "select s.*, t.st_hit_target_7d from q_st_trade t join q_sig s using (ticker, signal_date, pattern)")
for query, kind in {"md_logistic": "logistic", "md_margin": "margin", "md_rf": "random_forest", "md_gbt": "gbt"}.items():
    oracle(query, f"select {K}, st_hit_target_7d, {r(f'p_{kind}', 6)} as probability_calibrated from ({calibrated('q_short', {kind: SHORT[kind]}, f'{K}, st_hit_target_7d')})")
_each = [calibrated("(select * from q_hist where bars_available >= 30)", {t: T["stop_risk"][t]}, K) for t in TARGETS]
oracle("md_stop_risk", f"select {K}, " + ", ".join(f"{r(f'p_{t}', 4)} as {name}" for t, name in TARGETS.items()) + " from " + " join ".join(f"({x})" + (f" using ({K})" if i else "") for i, x in enumerate(_each)))


def gradient(target: str, table: dict, source: str, weight: str = "1.0::double") -> str:
    names = [*table["features"], *table["families"], "intercept"]
    beta = [*table["coefficients"], 0.0]
    return f"""
select '{target}' as target, unnest({names}) as "column", n as train_rows, pos as positives, unnest([{', '.join(f"(s[{i + 1}] / w + 0.5 / n * {b}::double)" for i, b in enumerate(beta))}]) as gradient
from (select count(*)::bigint as n, any_value(pos)::bigint as pos, sum(w) as w, [{', '.join(f'sum(w * (p - y) * x[{i + 1}])' for i in range(len(names)))}] as s from (
  select *, {raw(table)} as p, w0 * case when y = 1 then rows / (2.0::double * greatest(1, pos)) else rows / (2.0::double * greatest(1, rows - pos)) end as w from (
    select {target} as y, [{', '.join(inputs(table))}, 1.0::double] as x, {weight} as w0, count(*) over () as rows, sum({target}) over () as pos from {source} where {target} is not null)))"""


_WEIGHT = "exp(-ln(2) / 12 * ((select max(signal_date) from q_short) - signal_date) / 30.4375::double)"
oracle("md_gradient", "select target, \"column\", train_rows, positives, " + r("gradient", 6) + " as gradient from (" + " union all ".join(
    [gradient("st_hit_target_7d", SHORT["logistic"], "q_short", _WEIGHT), *(gradient(t, T["stop_risk"][t], "(select * from q_hist where bars_available >= 30)") for t in TARGETS)]) + ")")

# Ridge fits of candle flags and of catalysts.
_scopes = ", ".join(f"('{scope}', {[float(b) for b in beta]}::double[])" for scope, beta in T["candle_overlap"].items())
_x = ", ".join(f"{f}::int::double" for f in WEIGHT_FLAGS)
_age = "exp(-ln(2) / 12 * ((select max(signal_date) from q_flags) - signal_date) / 30.4375::double)"
oracle("wt_candle_overlap", f"""
with d as (select unnest([pattern_family, '__global__']) as scope, {_age} as w, (outcome = 'win')::int::double as y, [1.0::double, {_x}] as x from q_flags where outcome in ('win', 'loss')),
e as (select d.*, beta, y - list_dot_product(x, beta) as rest from d join (values {_scopes}) b(scope, beta) using (scope)),
s as (select scope, any_value(beta) as beta, sum(w) as total, [{', '.join(f'sum(w * x[{i}])' for i in range(2, len(WEIGHT_FLAGS) + 2))}] as n, [{', '.join(f'sum(w * x[{i}] * rest)' for i in range(2, len(WEIGHT_FLAGS) + 2))}] as g from e group by 1),
l as (select scope, unnest({list(WEIGHT_FLAGS)}) as flag, unnest(n) as n, unnest(g) as g, unnest(beta[2:]) as b, total from s),
h as (select *, b * 100 as pp, case when n > 0 then n / (n + 6) else 0 end as share from l)
select scope, flag, {r('n', 6)} as fit_weight, round(pp, 2) + 0::double as coef_pp, round(pp * share, 2) + 0::double as coef_pp_shrunk, round(share, 3) + 0::double as shrinkage,
  round_even(least(greatest(pp * share * 0.5, -10), 10) * 2, 0) / 2 + 0::double as weight, {r('(g - 8 * b) / total', 6)} as residual from h""")
_features = list(T["catalyst"])
_beta = list(T["catalyst"].values())
_k = len(_features)
oracle("md_cat_ridge", f"""
with d as (select (outcome = 'win')::int::double as y, [{', '.join(f'{f}::int::double' if f != 'event_proximity_score' else f for f in _features)}] as x
  from q_hist h join q_ev e using ({K}) left join q_reg g on g.date = h.signal_date),
z as (select y, x, list_transform(x, lambda v: coalesce(v, 0)) as f, list_dot_product(list_transform(x, lambda v: coalesce(v, 0)), {_beta}::double[]) as fit from d),
s as (select count(*) as n, [{', '.join(f'avg((x[{i}] is not null)::int)' for i in range(1, _k + 1))}] as cover, [{', '.join(f'covar_pop(f[{i}], y - fit)' for i in range(1, _k + 1))}] as rest,
  [{', '.join(f'stddev_pop(f[{i}])' for i in range(1, _k + 1))}] as sd from z),
l as (select unnest({_features}) as feature, unnest(cover) as cover, unnest({_beta}::double[]) as b, unnest(rest) as rest, unnest(list_transform(sd, lambda v: case when v > 0 then v else 1 end)) as sd, n from s)
select feature, {r('cover', 6)} as coverage, {r('least(greatest(b, -4), 4)', 2)} as coefficient, {r('rest / sd - 1 / n::double * b * sd', 6)} as residual from l""")
