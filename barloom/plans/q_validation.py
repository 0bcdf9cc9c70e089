"""Sweeps, walk-forward, resampling and overfitting queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from barloom.functions.scalars import MIX_I, MIX_SEED, MIX_SIM, PRIME, rounded
from barloom.operators import backtest as bt, features as feat, performance as perf, signals as sig, validation as val
from barloom.operators.timeline import attach, number
from barloom.plans.catalog import query
from barloom.plans.inputs import flag
from barloom.plans.q_performance import RET, _GROSS, _PERF, _SC, _psr, scenarios
from barloom.plans.sqltext import BY, FLAG, ema, r, with_
from barloom.session import cut

VALUES = {"fast": [5, 10, 20], "slow": [40, 80, 160]}
GRID = val.grid(**VALUES)
BASE = {"fast": 10, "slow": 80}
SIMS = 100


def _u(seed: int, src: str, name: str, keep: str) -> str:
    """CTEs adding column u of the draws, one arithmetic step per level."""
    p = PRIME
    return (f"{name}_0 AS (SELECT {keep}, (i::BIGINT * {MIX_I} + sim::BIGINT * {MIX_SIM} + {seed * MIX_SEED + 1}) % {p} AS v FROM {src}), "
            f"{name}_1 AS (SELECT *, (v * v) % {p} AS q FROM {name}_0), {name}_2 AS (SELECT {keep}, ((q * q) % {p} * v % {p} + 12345) % {p} AS v FROM {name}_1), "
            f"{name}_3 AS (SELECT *, (v * v) % {p} AS q FROM {name}_2), {name} AS (SELECT {keep}, (((q * q) % {p} * v % {p} + 67891) % {p})::DOUBLE / {p} AS u FROM {name}_3)")


_SPANS = sorted({s for p in GRID for s in p.values()})
_SWEEP = (ema("se", "bars", {f"e{s}": ("close", s) for s in _SPANS}, keep="close"),
          f"sl AS (SELECT *, close / lag(close) OVER ({BY}) - 1 AS r, " + ", ".join(f"lag(e{s}) OVER ({BY}) AS p{s}" for s in _SPANS) + " FROM se)",
          "sw AS (" + " UNION ALL ".join(
              f"SELECT symbol, ts, i - 1 AS i, {k} AS param, {p['fast']} AS fast, {p['slow']} AS slow, r * (CASE WHEN round(p{p['fast']} - p{p['slow']}, 9) > 0 THEN 1 ELSE 0 END) AS ret FROM sl WHERE r IS NOT NULL"
              for k, p in enumerate(GRID)) + ")",
          "sc AS (SELECT symbol, param, fast, slow, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252.0) AS score FROM sw GROUP BY symbol, param, fast, slow)")


def _sweep(spark, sf_dir):
    return cut(val.ema_cross_sweep(flag(spark, sf_dir), GRID))


@query("v11_grid_sweep", with_(FLAG, *_SWEEP, recursive=True) +
       f"SELECT symbol, fast, slow, {r('score')}, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, param) AS place FROM sc")
def v11(spark, sf_dir):
    df = val.sweep_scores(_sweep(spark, sf_dir))
    return rounded(df.select("symbol", "fast", "slow", "score", F.col("place").cast("bigint").alias("place")))


@query("f4_best_parameters", with_(FLAG, *_SWEEP, "rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, param) AS k FROM sc)", recursive=True) +
       f"SELECT symbol, fast, slow, {r('score')} FROM rk WHERE k <= 3")
def f4(spark, sf_dir):
    return rounded(val.sweep_scores(_sweep(spark, sf_dir)).where(F.col("place") <= 3).select("symbol", "fast", "slow", "score"))


_LOOKS = [5, 20, 60]


def _breakout(w, p):
    """A strategy of the user's own: long above the price ``look`` bars ago, short below it."""
    before = F.lag("close", p["look"]).over(w)
    return F.signum(F.round(F.col("close") - before, 9))


@query("j2_user_strategy", with_(FLAG, "lk AS (SELECT unnest(" + str(_LOOKS) + ") AS look)",
       "cl AS (SELECT symbol, ts, close, " + ", ".join(f"sign(round(close - lag(close, {n}) OVER ({BY}), 9)) AS s{n}" for n in _LOOKS) + " FROM bars)",
       "pl AS (SELECT symbol, ts, close / lag(close) OVER (" + BY + ") - 1 AS r, " + ", ".join(f"lag(s{n}) OVER ({BY}) AS p{n}" for n in _LOOKS) + " FROM cl)",
       "us AS (" + " UNION ALL ".join(f"SELECT symbol, {k} AS param, {n} AS look, r * coalesce(p{n}, 0) AS ret FROM pl WHERE r IS NOT NULL" for k, n in enumerate(_LOOKS)) + ")",
       "ug AS (SELECT symbol, param, look, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252.0) AS score FROM us GROUP BY symbol, param, look)") +
       f"SELECT symbol, look, {r('score')}, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, param) AS place FROM ug")
def j2(spark, sf_dir):
    rets = cut(val.sweep(flag(spark, sf_dir), [{"look": n} for n in _LOOKS], _breakout, max(_LOOKS)))
    df = val.sweep_scores(rets)
    return rounded(df.select("symbol", "look", "score", F.col("place").cast("bigint").alias("place")))


_WIN = """ws AS (SELECT row_number() OVER (ORDER BY s) - 1 AS window_id, CAST(s AS DATE) AS train_start FROM (SELECT unnest(generate_series(DATE '1995-01-02', DATE '2001-11-04', INTERVAL 63 DAY)) AS s)),
wn AS (SELECT window_id, train_start, train_start + 756 AS train_end, train_start + 757 AS test_start, train_start + 1009 AS test_end FROM ws WHERE train_start + 1009 <= DATE '2001-11-04')"""


def _windows(spark):
    return val.walk_forward_windows(spark, "1995-01-02", "2001-11-04")


@query("v1_walk_forward_windows", with_(FLAG, _WIN) + "SELECT CAST(window_id AS INT) AS window_id, train_start, train_end, test_start, test_end, count(*) FILTER (ts BETWEEN train_start AND train_end) AS train_rows, count(*) FILTER (ts BETWEEN test_start AND test_end) AS test_rows FROM wn JOIN bars ON ts BETWEEN train_start AND test_end GROUP BY ALL")
def v1(spark, sf_dir):
    from barloom.operators.joins import join_windows
    from barloom.sources.derived import bars_flag
    w = _windows(spark)
    df = join_windows(bars_flag(spark, sf_dir).select("ts"), w, "train_start", "test_end")
    return df.groupBy(*w.columns).agg(F.count_if(F.col("ts") <= F.col("train_end")).alias("train_rows"),
                                      F.count_if(F.col("ts") >= F.col("test_start")).alias("test_rows"))


_WF = (_WIN, """wm AS (SELECT symbol, window_id, param, coalesce(avg(ret) FILTER (ts <= train_end) / nullif(stddev_samp(ret) FILTER (ts <= train_end), 0), 0) * sqrt(252.0) AS a,
  coalesce(avg(ret) FILTER (ts >= test_start) / nullif(stddev_samp(ret) FILTER (ts >= test_start), 0), 0) * sqrt(252.0) AS b
  FROM sw JOIN wn ON ts BETWEEN train_start AND test_end GROUP BY symbol, window_id, param)""",
       "wk AS (SELECT *, row_number() OVER (PARTITION BY symbol, window_id ORDER BY round(a, 9) DESC, param) AS k FROM wm)", "wf AS (SELECT * FROM wk WHERE k = 1)")


@query("v2_walk_forward", with_(FLAG, *_SWEEP, *_WF, recursive=True) + f"""SELECT symbol, CAST(window_id AS INT) AS window_id, param, {r('a', 'train_metric')},
  {r('b', 'test_metric')}, {r('avg(b) OVER (PARTITION BY symbol)', 'average_test')} FROM wf""")
def v2(spark, sf_dir):
    return rounded(val.walk_forward(_sweep(spark, sf_dir), _windows(spark)))


@query("v14_walk_forward_stability", with_(FLAG, *_SWEEP, *_WF, "st AS (SELECT symbol, coalesce(corr(a, b), 0) AS c, avg(a) AS i, avg(b) AS o FROM wf GROUP BY symbol)", recursive=True) +
       f"SELECT symbol, {r('greatest(0, least(1, (c + 1) / 2 * greatest(0, least(1, o / (i + 1e-8)))))', 'stability')} FROM st")
def v14(spark, sf_dir):
    return rounded(val.walk_forward_stability(val.walk_forward(_sweep(spark, sf_dir), _windows(spark))))


@query("v12_parameter_sensitivity", with_(FLAG, *_SWEEP, "nr AS (SELECT * FROM sc WHERE slow = 80 UNION ALL SELECT * FROM sc WHERE fast = 10)", recursive=True) +
       f"SELECT symbol, {r('least(1, stddev_pop(score) / (abs(avg(score)) + 1e-8))', 'sensitivity')} FROM nr GROUP BY symbol")
def v12(spark, sf_dir):
    return rounded(val.parameter_sensitivity(val.sweep_scores(_sweep(spark, sf_dir)), BASE))


@query("v13_neighbour_stability", with_(FLAG, *_SWEEP, """nb AS (SELECT symbol, max(score) FILTER (fast = 10 AND slow = 80) AS b,
  avg(score) FILTER ((fast IN (5, 20) AND slow = 80) OR (fast = 10 AND slow IN (40, 160))) AS m,
  stddev_pop(score) FILTER ((fast IN (5, 20) AND slow = 80) OR (fast = 10 AND slow IN (40, 160))) AS s FROM sc GROUP BY symbol)""", recursive=True) +
       f"SELECT symbol, {r('greatest(0, 1 - least(1, (s / (abs(b) + 1e-8) + abs(b - m) / (abs(b) + 1e-8)) / 2))', 'stability')} FROM nb")
def v13(spark, sf_dir):
    return rounded(val.neighbour_stability(val.sweep_scores(_sweep(spark, sf_dir)), BASE, VALUES))


_PBO = ("nn AS (SELECT symbol, max(i) + 1 AS n FROM sw GROUP BY symbol)", "sp AS (SELECT unnest(range(16)) AS split)",
        "ps AS (SELECT sw.*, split, floor(n / 4 + split * n / 32.0) AS cut_at FROM sw JOIN nn USING (symbol) CROSS JOIN sp)",
        """pm AS (SELECT symbol, split, param, round(coalesce(avg(ret) FILTER (i < cut_at) / nullif(stddev_samp(ret) FILTER (i < cut_at), 0), 0) * sqrt(252.0), 9) AS a,
  round(coalesce(avg(ret) FILTER (i >= cut_at) / nullif(stddev_samp(ret) FILTER (i >= cut_at), 0), 0) * sqrt(252.0), 9) AS b FROM ps GROUP BY symbol, split, param
  HAVING count(*) FILTER (i < cut_at) >= 10 AND count(*) FILTER (i >= cut_at) >= 10)""",
        "pb AS (SELECT symbol, split, b AS best FROM (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY a DESC, param) AS k FROM pm) WHERE k = 1)",
        "pk AS (SELECT symbol, split, count(*) FILTER (b <= best) AS rank, count(*) AS k FROM pm JOIN pb USING (symbol, split) GROUP BY symbol, split)",
        "pq AS (SELECT symbol, count(*) FILTER (rank < k // 2) / count(*)::DOUBLE AS pbo FROM pk GROUP BY symbol)")


def _indexed(spark, sf_dir):
    """Sweep returns with row numbers per (symbol, param)."""
    return cut(number(_sweep(spark, sf_dir), keys=("symbol", "param")))


@query("v15_overfitting_probability", with_(FLAG, *_SWEEP, *_PBO, recursive=True) + f"SELECT symbol, {r('pbo')} FROM pq")
def v15(spark, sf_dir):
    return rounded(val.overfitting_probability(_indexed(spark, sf_dir)))


_MCS = ("mb AS (SELECT symbol, max(score) AS best, stddev_pop(score) AS sd, count(*) AS k FROM sc GROUP BY symbol)",
        "mc AS (SELECT symbol, count(*) FILTER (round(score, 9) >= round(CASE WHEN sd > 0 THEN best - sd ELSE best * 0.9 END, 9)) / count(*)::DOUBLE AS share FROM sc JOIN mb USING (symbol) GROUP BY symbol)")


@query("v17_model_confidence", with_(FLAG, *_SWEEP, *_MCS, recursive=True) + f"SELECT symbol, {r('share', 'confidence_share')} FROM mc")
def v17(spark, sf_dir):
    return rounded(val.model_confidence(val.sweep_scores(_sweep(spark, sf_dir))))


# -------------------------------------------------------------------- resampling

_RR = ("r1 AS (SELECT symbol, ts, ret, row_number() OVER (" + BY + ") - 1 AS i FROM (SELECT symbol, ts, close / lag(close) OVER (" + BY + ") - 1 AS ret FROM bars) WHERE ret IS NOT NULL)",
       "nn1 AS (SELECT symbol, count(*) AS n, stddev_samp(ret) AS sd, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252.0) AS original FROM r1 GROUP BY symbol)",
       f"sims AS (SELECT r1.*, n, sd, sim FROM r1 JOIN nn1 USING (symbol) CROSS JOIN (SELECT unnest(range({SIMS})) AS sim))")
_SHARPE = "coalesce(avg(x) / nullif(stddev_samp(x), 0), 0) * sqrt(252.0)"


def _rets(spark, sf_dir, bars=None):
    df = feat.returns(bars or flag(spark, sf_dir)).where(F.col("ret").isNotNull())
    return cut(df.select("symbol", "ts", (F.col("_i") - 1).alias("_i"), "ret"))


def _summary(test: str, c: float = 1.0, original: str = "original") -> str:
    o = original
    return (f"SELECT symbol, '{test}' AS test, {r(o, 'original')}, {r('m', 'mean_stressed')}, {r('s', 'std_stressed')}, {r('w', 'worst_case')}, n_sim, "
            f"{r(f'greatest(0, least(10, 10 * (1 - abs({o} - m) / (abs({o}) + 1)) / (1 + s * {c})))', 'robustness_score')} "
            "FROM (SELECT symbol, avg(metric) AS m, stddev_pop(metric) AS s, min(metric) AS w, count(metric) AS n_sim FROM mt GROUP BY symbol) JOIN og USING (symbol)")


_OG = "og AS (SELECT symbol, original FROM nn1)"


@query("v3_monte_carlo", with_(FLAG, *_RR, _u(42, "sims", "du", "symbol, ts, ret, i, sim"),
       "eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol, sim ORDER BY u, i) AS eq FROM du)",
       "dw AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, sim ORDER BY u, i) - 1 AS dd FROM eq)", "mt AS (SELECT symbol, sim, min(dd) AS metric FROM dw GROUP BY symbol, sim)",
       "oe AS (SELECT symbol, ts, product(1 + ret) OVER (" + BY + ") AS eq FROM r1)", "od AS (SELECT symbol, eq / max(eq) OVER (" + BY + ") - 1 AS dd FROM oe)",
       "og AS (SELECT symbol, min(dd) AS original FROM od GROUP BY symbol)") + _summary("Monte Carlo Shuffle"))
def v3(spark, sf_dir):
    rets = _rets(spark, sf_dir)
    original = perf.max_drawdown(rets, ["symbol"]).select("symbol", F.col("max_dd").alias("original"))
    return rounded(val.robustness(val.monte_carlo_drawdown(rets, SIMS), original, "Monte Carlo Shuffle"))


@query("v4_bootstrap", with_(FLAG, *_RR, _u(43, "sims", "du", "symbol, i, sim, n"), "pk AS (SELECT symbol, sim, CAST(floor(u * n) AS BIGINT) AS i FROM du)",
       f"mt AS (SELECT symbol, sim, {_SHARPE.replace('x', 'ret')} AS metric FROM pk JOIN r1 USING (symbol, i) GROUP BY symbol, sim)", _OG) + _summary("Bootstrap"))
def v4(spark, sf_dir):
    rets = _rets(spark, sf_dir)
    return rounded(val.robustness(val.bootstrap(rets, n=SIMS), val.original_metric(rets, perf.sharpe), "Bootstrap"))


@query("v5_noise_injection", with_(FLAG, *_RR, _u(44, "sims", "du", "symbol, i, sim, ret, sd"), _u(44 + 7919, "sims", "dv", "symbol, i, sim"),
       "nz AS (SELECT symbol, sim, ret + sqrt(-2 * ln(1 - du.u)) * cos(6.283185307179586 * dv.u) * sd * 0.1 AS x FROM du JOIN dv USING (symbol, i, sim))",
       f"mt AS (SELECT symbol, sim, {_SHARPE} AS metric FROM nz GROUP BY symbol, sim)", _OG) + _summary("Noise Injection"))
def v5(spark, sf_dir):
    rets = _rets(spark, sf_dir)
    return rounded(val.robustness(val.noise_injection(rets, n=SIMS), val.original_metric(rets, perf.sharpe), "Noise Injection"))


_V6 = ("al AS (SELECT list_transform(list_concat([10.0::DOUBLE], list_transform(range(100), lambda k: 80 * (1 + (-0.1::DOUBLE + k * (0.2::DOUBLE / 99)))), [80.0::DOUBLE]), lambda s: 2.0::DOUBLE / (s + 1)) AS a)",
       f"vn AS MATERIALIZED (SELECT *, row_number() OVER ({BY}) - 1 AS i FROM bars CROSS JOIN al)",
       """ve AS (SELECT symbol, ts, i, close, list_transform(a, lambda x: close) AS e FROM vn WHERE i = 0 UNION ALL
  SELECT n.symbol, n.ts, n.i, n.close, list_transform(list_zip(n.a, p.e), lambda z: z[1] * n.close + (1 - z[1]) * z[2]) FROM ve p JOIN vn n ON n.symbol = p.symbol AND n.i = p.i + 1)""",
       f"vl AS (SELECT symbol, close / lag(close) OVER ({BY}) - 1 AS r, lag(e) OVER ({BY}) AS pe FROM ve)",
       "vr AS (SELECT symbol, sim, CASE WHEN round(pe[1] - pe[sim + 2], 9) > 0 THEN r ELSE 0 END AS x FROM vl CROSS JOIN (SELECT unnest(range(101)) AS sim) WHERE r IS NOT NULL)",
       f"vm AS (SELECT symbol, sim, {_SHARPE} AS metric FROM vr GROUP BY symbol, sim)")


@query("v6_parameter_perturbation", with_(FLAG, *_V6, "og AS (SELECT symbol, metric AS original FROM vm WHERE sim = 100)", "mt AS (SELECT * FROM vm WHERE sim < 100)",
       recursive=True) + _summary("Parameter Perturbation", 5.0))
def v6(spark, sf_dir):
    return rounded(_perturbed(flag(spark, sf_dir)))


def _perturbed(bars):
    """100 slow spans within 10 % of 80, against 80 itself."""
    sims = cut(val.parameter_perturbation(bars, 10, 80, n=SIMS))
    original = sims.where(F.col("sim") == SIMS).select("symbol", F.col("metric").alias("original"))
    return val.robustness(sims.where(F.col("sim") < SIMS), original, "Parameter Perturbation", c=5.0)


@query("v7_start_dates", with_(FLAG, *_RR, f"sd AS (SELECT *, floor(floor(n * 0.0::DOUBLE) + (floor(n * 0.3::DOUBLE) - floor(n * 0.0::DOUBLE)) * (sim / {SIMS - 1}.0::DOUBLE)) AS st FROM sims)",
       f"mt AS (SELECT symbol, sim, {_SHARPE.replace('x', 'ret')} AS metric FROM sd WHERE i >= st AND n - st >= 30 GROUP BY symbol, sim)", _OG) + _summary("Start Dates"))
def v7(spark, sf_dir):
    rets = _rets(spark, sf_dir)
    return rounded(val.robustness(val.start_dates(rets, n=SIMS), val.original_metric(rets, perf.sharpe), "Start Dates"))


@query("v8_missing_data", with_(FLAG, *_RR, _u(45, "sims", "du", "symbol, i, sim, ret"), "ms AS (SELECT symbol, sim, CASE WHEN u < 0.05 THEN 0 ELSE ret END AS x FROM du)",
       f"mt AS (SELECT symbol, sim, {_SHARPE} AS metric FROM ms GROUP BY symbol, sim)", _OG) + _summary("Missing Data", 2.0))
def v8(spark, sf_dir):
    rets = _rets(spark, sf_dir)
    return rounded(val.robustness(val.missing_data(rets, n=SIMS), val.original_metric(rets, perf.sharpe), "Missing Data", c=2.0))


def _score_cte(test: str, sims: str, c: float, original: str = "og1") -> str:
    """SELECT of one test's score from its simulated metrics."""
    return (f"SELECT symbol, '{test}' AS test, greatest(0, least(10, 10 * (1 - abs(original - m) / (abs(original) + 1)) / (1 + s * {c}))) AS sc "
            f"FROM (SELECT symbol, avg(metric) AS m, stddev_pop(metric) AS s FROM {sims} GROUP BY symbol) JOIN {original} USING (symbol)")


def _level_cte(test: str, commission: float) -> str:
    """SELECT of a cost or slippage score over 0, 1, 2, 5 and 10 basis points."""
    x = f"ret - turnover * (bps + {commission}) / 10000"
    return (f"SELECT symbol, '{test}', greatest(0, least(10, 10 * (1 - abs(o - w) / (abs(o) + 1)))) FROM (SELECT symbol, max(k) FILTER (bps = 2) AS o, min(k) AS w FROM "
            f"(SELECT symbol, bps, coalesce(avg({x}) / nullif(stddev_samp({x}), 0), 0) * sqrt(252.0) AS k FROM gr CROSS JOIN (SELECT unnest([0, 1, 2, 5, 10])::DOUBLE AS bps) "
            "GROUP BY symbol, bps) GROUP BY symbol)")


_V10 = (*_RR, "og1 AS (SELECT symbol, original FROM nn1)", _u(42, "sims", "d3", "symbol, ts, ret, i, sim"),
        "e3 AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol, sim ORDER BY u, i) AS eq FROM d3)",
        "w3 AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, sim ORDER BY u, i) - 1 AS dd FROM e3)", "m3 AS (SELECT symbol, sim, min(dd) AS metric FROM w3 GROUP BY symbol, sim)",
        "oe AS (SELECT symbol, ts, product(1 + ret) OVER (" + BY + ") AS eq FROM r1)", "od AS (SELECT symbol, eq / max(eq) OVER (" + BY + ") - 1 AS dd FROM oe)",
        "og3 AS (SELECT symbol, min(dd) AS original FROM od GROUP BY symbol)",
        _u(43, "sims", "d4", "symbol, i, sim, n"), "p4 AS (SELECT symbol, sim, CAST(floor(u * n) AS BIGINT) AS i FROM d4)",
        f"m4 AS (SELECT symbol, sim, {_SHARPE.replace('x', 'ret')} AS metric FROM p4 JOIN r1 USING (symbol, i) GROUP BY symbol, sim)",
        _u(44, "sims", "d5", "symbol, i, sim, ret, sd"), _u(44 + 7919, "sims", "d6", "symbol, i, sim"),
        "n5 AS (SELECT symbol, sim, ret + sqrt(-2 * ln(1 - d5.u)) * cos(6.283185307179586 * d6.u) * sd * 0.1 AS x FROM d5 JOIN d6 USING (symbol, i, sim))",
        f"m5 AS (SELECT symbol, sim, {_SHARPE} AS metric FROM n5 GROUP BY symbol, sim)", *_V6,
        "og6 AS (SELECT symbol, metric AS original FROM vm WHERE sim = 100)", "m6 AS (SELECT * FROM vm WHERE sim < 100)",
        f"s7 AS (SELECT *, floor(floor(n * 0.3::DOUBLE) * (sim / {SIMS - 1}.0::DOUBLE)) AS st FROM sims)",
        f"m7 AS (SELECT symbol, sim, {_SHARPE.replace('x', 'ret')} AS metric FROM s7 WHERE i >= st AND n - st >= 30 GROUP BY symbol, sim)",
        _u(45, "sims", "d8", "symbol, i, sim, ret"), "n8 AS (SELECT symbol, sim, CASE WHEN u < 0.05 THEN 0 ELSE ret END AS x FROM d8)",
        f"m8 AS (SELECT symbol, sim, {_SHARPE} AS metric FROM n8 GROUP BY symbol, sim)", *_GROSS,
        "sy AS (" + " UNION ALL ".join([
            _score_cte("Monte Carlo Shuffle", "m3", 1, "og3"), _score_cte("Bootstrap", "m4", 1), _score_cte("Noise Injection", "m5", 1),
            _score_cte("Parameter Perturbation", "m6", 5, "og6"), _score_cte("Start Dates", "m7", 1), _score_cte("Missing Data", "m8", 2),
            _level_cte("Transaction Cost Sensitivity", 0), _level_cte("Slippage Sensitivity", 2)]) + ")")


@query("v10_overall_robustness", with_(FLAG, *_V10, recursive=True) +
       f"""SELECT symbol, {r('avg(sc)', 'overall_score', 2)}, {r('median(sc)', 'median_score', 2)}, {r('min(sc)', 'min_score', 2)}, {r('max(sc)', 'max_score', 2)},
  {r('stddev_pop(sc)', 'std_score', 2)}, min_by(test, sc) AS worst_test, count(*) AS num_tests,
  CASE WHEN avg(sc) >= 7 THEN 'Robust' WHEN avg(sc) >= 4 THEN 'Moderate' ELSE 'Fragile' END AS interpretation,
  string_agg(test || '=' || printf('%.2f', sc), '; ' ORDER BY test) AS breakdown FROM sy GROUP BY symbol""")
def v10(spark, sf_dir):
    """All eight tests: six on the symbol's returns or its EMA strategy, two on the costs of that strategy."""
    bars = flag(spark, sf_dir)
    rets = _rets(spark, sf_dir, bars)
    original = cut(val.original_metric(rets, perf.sharpe))
    deepest = perf.max_drawdown(rets, ["symbol"]).select("symbol", F.col("max_dd").alias("original"))
    gross = cut(bt.strategy_returns(bt.state_position(sig.ema_cross(bars), 0), cost=0.0).select("symbol", "ts", "ret", "turnover"))
    tests = [
        val.robustness(val.monte_carlo_drawdown(rets, SIMS), deepest, "Monte Carlo Shuffle"),
        val.robustness(val.bootstrap(rets, n=SIMS), original, "Bootstrap"),
        val.robustness(val.noise_injection(rets, n=SIMS), original, "Noise Injection"),
        _perturbed(bars),
        val.robustness(val.start_dates(rets, n=SIMS), original, "Start Dates"),
        val.robustness(val.missing_data(rets, n=SIMS), original, "Missing Data", c=2.0),
        val.cost_robustness(val.cost_curve(gross, val.LEVELS), "Transaction Cost Sensitivity"),
        val.cost_robustness(val.cost_curve(gross, val.LEVELS, commission=2.0), "Slippage Sensitivity")]
    return val.overall_robustness(reduce(DataFrame.unionByName, [t.select("symbol", "test", "robustness_score") for t in tests]))


_RC = ("bn AS (SELECT ts, ret AS bench_ret FROM r1 WHERE symbol = 'AF')",
       "p1 AS (SELECT symbol, ts, ret, bench_ret, row_number() OVER (" + BY + ") - 1 AS i FROM r1 JOIN bn USING (ts))",
       f"ob AS (SELECT symbol, count(*) AS n, {_SHARPE.replace('x', 'ret')} - {_SHARPE.replace('x', 'bench_ret')} AS obs FROM p1 GROUP BY symbol)",
       f"s1 AS (SELECT p1.symbol, i, n, sim FROM p1 JOIN ob USING (symbol) CROSS JOIN (SELECT unnest(range({SIMS})) AS sim))",
       _u(46, "s1", "dr", "symbol, i, sim, n"), "ix AS (SELECT symbol, sim, CAST(floor(u * n) AS BIGINT) AS i FROM dr)",
       f"xs AS (SELECT symbol, sim, {_SHARPE.replace('x', 'ret')} - {_SHARPE.replace('x', 'bench_ret')} AS x FROM ix JOIN p1 USING (symbol, i) GROUP BY symbol, sim)",
       "pv AS (SELECT symbol, avg(CASE WHEN x - obs >= obs THEN 1.0 ELSE 0.0 END) AS centred, avg(CASE WHEN x >= obs THEN 1.0 ELSE 0.0 END) AS plain FROM xs JOIN ob USING (symbol) WHERE symbol <> 'AF' GROUP BY symbol)")


def _paired(spark, sf_dir):
    rets = _rets(spark, sf_dir)
    bench = rets.where(F.col("symbol") == "AF").select("ts", F.col("ret").alias("bench_ret"))
    return cut(number(rets.drop("_i").join(bench, "ts"))).where(F.col("symbol") != "AF")


@query("v16_reality_check", with_(FLAG, *_RR, *_RC) + f"SELECT symbol, {r('centred', 'p_centred')}, {r('plain', 'p_plain')} FROM pv")
def v16(spark, sf_dir):
    p = cut(_paired(spark, sf_dir))
    a = val.reality_check(p, SIMS).withColumnRenamed("p_value", "p_centred")
    b = val.reality_check(p, SIMS, centred=False).withColumnRenamed("p_value", "p_plain")
    return rounded(a.join(b, "symbol"))


_V18 = ("nr AS (SELECT * FROM sc WHERE slow = 80 UNION ALL SELECT * FROM sc WHERE fast = 10)",
        "se1 AS (SELECT symbol, least(1, stddev_pop(score) / (abs(avg(score)) + 1e-8)) AS sensitivity FROM nr GROUP BY symbol)",
        """nb AS (SELECT symbol, max(score) FILTER (fast = 10 AND slow = 80) AS b,
  avg(score) FILTER ((fast IN (5, 20) AND slow = 80) OR (fast = 10 AND slow IN (40, 160))) AS m,
  stddev_pop(score) FILTER ((fast IN (5, 20) AND slow = 80) OR (fast = 10 AND slow IN (40, 160))) AS s FROM sc GROUP BY symbol)""",
        "ns AS (SELECT symbol, greatest(0, 1 - least(1, (s / (abs(b) + 1e-8) + abs(b - m) / (abs(b) + 1e-8)) / 2)) AS neighbour FROM nb)",
        "st AS (SELECT symbol, coalesce(corr(a, b), 0) AS c, avg(a) AS i, avg(b) AS o FROM wf GROUP BY symbol)",
        "wfs AS (SELECT symbol, greatest(0, least(1, (c + 1) / 2 * greatest(0, least(1, o / (i + 1e-8))))) AS walk_forward FROM st)",
        f"ds AS (SELECT symbol, {_psr('sharpe', perf.deflated_threshold(10))} AS dsr FROM p2)",
        """tt AS (SELECT symbol, round(sensitivity, 9) AS sensitivity, round(neighbour, 9) AS neighbour, round(walk_forward, 9) AS walk_forward, pbo, round(dsr, 9) AS dsr,
  coalesce(centred, 1.0) AS p_value, share FROM pq JOIN mc USING (symbol) JOIN ds USING (symbol) JOIN se1 USING (symbol) JOIN ns USING (symbol)
  JOIN wfs USING (symbol) LEFT JOIN pv USING (symbol))""",
        """tu AS (SELECT *, greatest(0, least(10, sensitivity * 2 + (1 - neighbour) * 2 + (1 - walk_forward) * 2 + pbo * 2 + (1 - dsr) * 2 + p_value + share)) AS overall FROM tt)""")


@query("v18_overfitting_score", with_(FLAG, *_SWEEP, *_PBO, *_MCS, RET, _PERF, *_WF, *_RR, *_RC, *_V18, recursive=True) +
       f"""SELECT symbol, {r('sensitivity')}, {r('neighbour')}, {r('walk_forward')}, {r('pbo')}, {r('dsr')}, {r('p_value')}, {r('share', 'confidence_share')},
  {r('overall', 'overall', 5)}, overall >= 6 AS is_overfitted, array_to_string(list_filter([CASE WHEN sensitivity > 0.5 THEN 'parameter sensitivity' END,
  CASE WHEN neighbour < 0.5 THEN 'neighbour stability' END, CASE WHEN walk_forward < 0.5 THEN 'walk-forward stability' END,
  CASE WHEN pbo > 0.5 THEN 'backtest overfitting probability' END, CASE WHEN dsr < 0.8 THEN 'deflated Sharpe' END,
  CASE WHEN p_value > 0.5 THEN 'reality check' END, CASE WHEN share > 0.7 THEN 'model confidence' END,
  CASE WHEN overall >= 6 THEN 'overfitting detected' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM tu""")
def v18(spark, sf_dir):
    """All seven inputs; the benchmark itself has no excess to test, so its p-value is 1."""
    sweep = _indexed(spark, sf_dir)
    scores = cut(val.sweep_scores(sweep))
    dsr = perf.metrics(flag(spark, sf_dir).select("symbol", "ts", "close"), ("symbol",), "close").select("symbol", F.round("dsr_annualised", 9).alias("dsr"))
    walk = val.walk_forward_stability(val.walk_forward(sweep.drop("_i"), _windows(spark))).select("symbol", F.round("stability", 9).alias("walk_forward"))
    parts = val.overfitting_probability(sweep).join(val.model_confidence(scores), "symbol").join(dsr, "symbol")
    parts = parts.join(val.parameter_sensitivity(scores, BASE).select("symbol", F.round("sensitivity", 9).alias("sensitivity")), "symbol")
    parts = parts.join(val.neighbour_stability(scores, BASE, VALUES).select("symbol", F.round("stability", 9).alias("neighbour")), "symbol")
    parts = parts.join(walk, "symbol").join(val.reality_check(_paired(spark, sf_dir), SIMS), "symbol", "left")
    df = val.overfitting_score(parts.withColumn("p_value", F.coalesce("p_value", F.lit(1.0))))
    cols = ("sensitivity", "neighbour", "walk_forward", "pbo", "dsr", "p_value", "confidence_share")
    return df.select("symbol", *[F.round(c, 6).alias(c) for c in cols], F.round("overall", 5).alias("overall"), "is_overfitted",
                     F.array_join("warnings", "; ").alias("warnings"))


def _points(x: str) -> str:
    return f"CASE WHEN {x} >= 1.2 THEN 2.0 WHEN {x} >= 0.8 THEN 1.5 WHEN {x} >= 0.5 THEN 1.0 WHEN {x} >= 0.2 THEN 0.5 ELSE 0.2 END"


_H6 = (f"ho AS (SELECT symbol, i, ret, max(i) OVER (PARTITION BY symbol) + 1 AS n FROM sw WHERE param = {GRID.index(BASE)})",
       """hs AS (SELECT symbol, round(coalesce(avg(ret) FILTER (i < floor(n * 0.7::DOUBLE)) / nullif(stddev_samp(ret) FILTER (i < floor(n * 0.7::DOUBLE)), 0), 0) * sqrt(252.0), 9) AS is_sharpe,
  round(coalesce(avg(ret) FILTER (i >= floor(n * 0.7::DOUBLE)) / nullif(stddev_samp(ret) FILTER (i >= floor(n * 0.7::DOUBLE)), 0), 0) * sqrt(252.0), 9) AS oos_sharpe FROM ho GROUP BY symbol)""",
       "wa AS (SELECT symbol, is_sharpe, oos_sharpe, round(avg(b), 9) AS walk_forward, coalesce(corr(a, b), 0) AS c, avg(a) AS i, avg(b) AS o FROM wf JOIN hs USING (symbol) GROUP BY symbol, is_sharpe, oos_sharpe)",
       "nr AS (SELECT * FROM sc WHERE slow = 80 UNION ALL SELECT * FROM sc WHERE fast = 10)",
       "sv AS (SELECT symbol, 1 - least(1, stddev_pop(score) / (abs(avg(score)) + 1e-8)) AS sensitivity FROM nr GROUP BY symbol)",
       _SC.replace("sc(name, s, e)", "scen(name, s, e)"),
       """ds AS (SELECT symbol, name, close / max(close) OVER (PARTITION BY symbol, name ORDER BY ts) - 1 AS dd FROM bars
  JOIN scen ON ts BETWEEN CAST(s AS DATE) AND CAST(e AS DATE))""",
       "sd AS (SELECT symbol, round(1 + min(dd), 9) AS stress FROM ds GROUP BY symbol)",
       """vs AS (SELECT symbol, is_sharpe, oos_sharpe, walk_forward, stress, sensitivity, greatest(0, least(1, (c + 1) / 2 * greatest(0, least(1, o / (i + 1e-8))))) AS temporal,
  (SELECT count(*) FILTER (oos_sharpe > 0) / count(*)::DOUBLE FROM wa) AS cross_asset FROM wa JOIN sv USING (symbol) LEFT JOIN sd USING (symbol))""",
       f"""pt AS (SELECT *, CASE WHEN cross_asset = 0 THEN 8.5 ELSE 10.0 END::DOUBLE AS available, ({_points('is_sharpe')} + {_points('oos_sharpe')}
  + CASE WHEN walk_forward > 1 THEN 2.0 WHEN walk_forward > 0.5 THEN 1.5 ELSE 0.7 END + CASE WHEN stress > 0.8 THEN 1.5 ELSE 1.0 END)::DOUBLE
  + temporal + cross_asset + sensitivity AS raw FROM vs)""")


@query("h6_validation_score", with_(FLAG, *_SWEEP, *_WF, *_H6, recursive=True) + f"""SELECT symbol, {r('is_sharpe')}, {r('oos_sharpe')}, {r('walk_forward')}, {r('stress')}, {r('temporal')},
  {r('cross_asset')}, {r('sensitivity')}, {r('raw', 'score_raw')}, available AS score_available, {r('raw / available * 10', 'score_normalised', 2)},
  CASE WHEN available = 8.5 THEN 85.0 ELSE 100.0 END::DOUBLE AS coverage_pct FROM pt""")
def h6(spark, sf_dir):
    """In and out of sample: the base set on the first 70 % of its rows and on the rest. Walk-forward: the mean test Sharpe of the
    best set of each window. Further the stability of the windows, the worst scenario drawdown, the sweep's sensitivity, and the
    share of symbols with a positive out-of-sample Sharpe as the cross-asset part."""
    sweep = _indexed(spark, sf_dir)
    base = val.holdout(sweep.where(F.col("param") == GRID.index(BASE)))
    walk = cut(val.walk_forward(sweep, _windows(spark)))
    m = walk.groupBy("symbol").agg(F.round(F.max("average_test"), 9).alias("walk_forward")).join(
        base.select("symbol", F.round("in_sample", 9).alias("is_sharpe"), F.round("out_of_sample", 9).alias("oos_sharpe")), "symbol")
    m = cut(m)
    share = m.agg((F.count_if(F.col("oos_sharpe") > 0) / F.count(F.lit(1))).alias("cross_asset"))
    curve = cut(flag(spark, sf_dir).select("symbol", "ts", "close"))
    stress = val.historical_stress(curve, scenarios(spark), ("symbol",), "close").groupBy("symbol").agg(F.round(1 + F.min("max_dd"), 9).alias("stress"))
    steady = val.parameter_sensitivity(val.sweep_scores(sweep), BASE).select("symbol", (1 - F.col("sensitivity")).alias("sensitivity"))
    parts = attach(m, share).join(val.walk_forward_stability(walk).withColumnRenamed("stability", "temporal"), "symbol")
    parts = parts.join(steady, "symbol").join(stress, "symbol", "left")
    return rounded(val.validation_score(parts).select("symbol", "is_sharpe", "oos_sharpe", "walk_forward", "stress", "temporal", "cross_asset", "sensitivity",
                                                      "score_raw", "score_available", "score_normalised", "coverage_pct"))
