"""Parameter sweeps: all trials of all keys are groups of one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import layout, metrics, signals, trades
from barloom.operators.layout import BLOCK
from barloom.operators.trades import Account, Costs
from barloom.plans import validation
from barloom.plans.resample import _P, drawn_int


@dataclass(frozen=True)
class Objective:
    in_fraction: float = 0.70
    warmup: int = 250
    min_trades: int = 20
    w_sharpe: float = 1.0
    w_cagr: float = 0.5
    w_drawdown: float = 1.0
    w_gap: float = 0.5


def draw_parameters(name: str, n_trials: int = 60, seed: int = 42) -> list[dict]:
    """Uniform draws from the search space of a strategy; integer bounds are inclusive."""
    space = signals.get_strategy(name).space
    sets = []
    for trial in range(n_trials):
        params = {}
        for at, (key, spec) in enumerate(space.items()):
            x = drawn_int(seed, trial, at)
            if spec[0] == "int":
                params[key] = int(spec[1]) + x % (int(spec[2]) - int(spec[1]) + 1)
            elif spec[0] == "float":
                params[key] = round(float(spec[1]) + (float(spec[2]) - float(spec[1])) * x / _P, 6)
            else:
                params[key] = spec[1][x % len(spec[1])]
        sets.append(params)
    return sets


def score(o: Objective) -> Column:
    """Composite trial score; -Infinity below the trade floor or if not finite."""
    gap = F.abs(F.col("is_sharpe") - F.col("oos_sharpe"))
    value = (o.w_sharpe * F.col("is_sharpe") + o.w_cagr * F.col("is_cagr")
             - o.w_drawdown * F.abs(F.col("is_max_drawdown")) - o.w_gap * gap)
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when((F.col("is_n_trades") >= o.min_trades) & finite, value).otherwise(F.lit(float("-inf")))


def deals_for(bars: DataFrame, keys: tuple[str, ...], n_sets: int) -> int:
    """Into how many partitions the sets of a key are dealt, so that few keys use all cores; 1 where keys abound."""
    wanted = 2 * bars.sparkSession.sparkContext.defaultParallelism
    known = bars.select(*keys).distinct().limit(wanted).count()  # reads on only until there are enough keys
    return max(1, min(n_sets, -(-wanted // max(1, known))))


def trials(bars: DataFrame, keys: tuple[str, ...], name: str, sets: list[dict], objective: Objective = Objective(),
           timeframe: str = "1d", costs: Costs = Costs(), account: Account = Account(), step_seconds: int = 86400,
           block: int = BLOCK) -> DataFrame:
    """One row per (key, param_id): is_ and oos_ metrics and the score."""
    _, curve = validation.run_split(bars, keys, name, sets, objective.in_fraction, objective.warmup, costs, account,
                                    step_seconds, block, deals_for(bars, keys, len(sets)))
    per_segment = metrics.summarize(curve, timeframe)
    wide = validation.side_by_side(per_segment, [*keys, "param_id"])
    return wide.withColumn("score", score(objective))


def best_trial(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Highest score per key, the first trial on ties; no finite score gives param_id NULL and score 0."""
    top = scored.groupBy(*keys).agg(
        F.max_by(F.struct("param_id", "score"), F.struct("score", -F.col("param_id"))).alias("_t"),
        F.count(F.lit(1)).alias("n_trials"))
    finite = F.col("_t.score") > F.lit(float("-inf"))
    return top.select(*keys, F.when(finite, F.col("_t.param_id")).alias("param_id"),
                      F.when(finite, F.col("_t.score")).otherwise(0.0).alias("score"), "n_trials")


def sensitivity_sets(name: str, base: dict | None = None, steps: int = 5, rel_range: float = 0.25) -> list[tuple[str, float, dict]]:
    """(parameter, value, parameter set): one numeric parameter at a time over an even grid around its base."""
    strategy = signals.get_strategy(name)
    params = signals.with_defaults(strategy, base)
    out = []
    for key, spec in strategy.space.items():
        if spec[0] not in ("int", "float") or params.get(key) is None:
            continue
        low, high = params[key] * (1 - rel_range), params[key] * (1 + rel_range)
        for i in range(steps):
            v = low + (high - low) * i / (steps - 1) if steps > 1 else low
            value = int(round(v)) if spec[0] == "int" else float(v)
            if spec[0] == "int" and value < 1:
                continue  # no such window: the run would fail
            out.append((key, value, {**(base or {}), key: value}))
    return out


def sensitivity(laid_of, name: str, base: dict | None = None, steps: int = 5, rel_range: float = 0.25,
                timeframe: str = "1d", costs: Costs = Costs(), account: Account = Account()) -> DataFrame:
    """Metrics of every perturbed run: (keys, param, value, metrics)."""
    grid = sensitivity_sets(name, base, steps, rel_range)
    strategy = signals.get_strategy(name)
    sets = [signals.with_defaults(strategy, g[2]) for g in grid]
    s = signals.generate(laid_of(signals.halo_of(strategy, sets)), name, sets)
    per_run = metrics.summarize(trades.backtest(s, costs, account, stream=True)[1], timeframe)
    names = F.array(*[F.lit(g[0]) for g in grid])
    values = F.array(*[F.lit(float(g[1])) for g in grid])
    return per_run.withColumns({"param": F.get(names, F.col("param_id")), "value": F.get(values, F.col("param_id"))})


def robustness(table: DataFrame, keys: list[str], metric: str = "sharpe") -> DataFrame:
    """1 - mean coefficient of variation of the metric over the parameters, at least 0; none usable gives 0."""
    per_param = table.groupBy(*keys, "param").agg(F.avg(metric).alias("_m"), F.stddev_pop(metric).alias("_s"))
    cv = F.when(F.abs("_m") > 1e-9, F.abs(F.col("_s") / F.nullif(F.col("_m"), F.lit(0.0))))
    return per_param.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.avg(cv), F.lit(1.0))).alias("robustness"))
