"""The search for parameters: trials drawn in batches, scored fold by fold, ended early by the median, guided by densities.

A batch of trials goes through the rolling folds in stages. A stage is one Spark job over the trials that are
left, a fit for each trial and fold; what goes to the driver is a number a fit. Which trials end, and after
which fold, is what a replay fold by fold says, so the length of a stage changes no result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import models
from .boosting import Trees
from ..sources.tables import Tables

#: The ranges that parameters are drawn from, as (low, high, whether by the logarithm).
RANGES = {
    "n_estimators": (100, 400, False), "learning_rate": (0.02, 0.08, True), "num_leaves": (15, 127, False), "min_child_samples": (30, 400, False),
    "subsample": (0.6, 0.8, False), "colsample_bytree": (0.6, 0.8, False), "lambda_l1": (1e-3, 50.0, True), "lambda_l2": (1e-2, 20.0, True),
}


@dataclass
class Trial:
    """A trial: its parameters, the score after each fold, and whether the median ended it."""

    number: int
    params: dict
    ratios: list[float] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    pruned: bool = False


@dataclass(frozen=True)
class Plan:
    """How a search goes: trials in all and at a time, random ones first, finished ones that the median asks for, folds without pruning, the share of trials held good, at most so many, candidates a draw."""

    trials: int = 60
    batch: int = 5
    random: int = 10
    finished: int = 5
    warmup: int = 1
    good: float = 0.1
    most_good: int = 25
    candidates: int = 24
    recent: int = 10
    stage: int = 25
    seed: int = 42


def draw_at_random(rng: np.random.Generator, ranges: dict = RANGES) -> dict:
    """Parameters drawn independently; whole numbers where both ends are."""
    return {name: back(rng.uniform(*span(low, high, log)), low, high, log) for name, (low, high, log) in ranges.items()}


def span(low: float, high: float, log: bool) -> tuple[float, float]:
    """The ends on the scale that values are drawn on; whole numbers reach half a step further."""
    if isinstance(low, int):
        low, high = low - 0.5, high + 0.5
    return (math.log(low), math.log(high)) if log else (float(low), float(high))


def back(v: float, low: float, high: float, log: bool) -> float:
    x = math.exp(v) if log else v
    return min(max(round(x), low), high) if isinstance(low, int) else min(max(float(x), low), high)


class Density:
    """A mixture of normal kernels within [low, high], one at each value and a wide one in the middle; a kernel is as wide as the gap to its neighbours."""

    def __init__(self, values: np.ndarray, low: float, high: float):
        self.low, self.high = low, high
        at = np.append(values, (low + high) / 2)
        order = np.argsort(at, kind="stable")
        ends = np.concatenate([[low], at[order], [high]])
        width = np.empty(len(at))
        width[order] = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1])
        width = np.clip(width, (high - low) / min(100, len(at) + 1), high - low)
        width[-1] = high - low
        self.at, self.width = at, width
        cdf = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
        self.mass = cdf((high - at) / width) - cdf((low - at) / width)

    def draw(self, rng: np.random.Generator, many: int) -> np.ndarray:
        out = np.empty(many)
        for i, k in enumerate(rng.integers(len(self.at), size=many)):
            v = rng.normal(self.at[k], self.width[k])
            while not self.low <= v <= self.high:
                v = rng.normal(self.at[k], self.width[k])
            out[i] = v
        return out

    def log(self, v: np.ndarray) -> np.ndarray:
        z = (v[:, None] - self.at) / self.width
        p = np.exp(-z * z / 2) / (self.width * math.sqrt(2 * math.pi) * self.mass)
        return np.log(np.maximum(p.mean(axis=1), 1e-300))


def ranked(trials: list[Trial]) -> list[Trial]:
    """Best first: finished ones by score, then those that ended early, the later the better, by score."""
    return sorted((t for t in trials if t.scores), key=lambda t: (t.pruned, -len(t.scores) if t.pruned else 0, t.scores[-1], t.number))


def draw_guided(rng: np.random.Generator, trials: list[Trial], plan: Plan = Plan(), ranges: dict = RANGES) -> dict:
    """Each parameter by itself: of candidates from the good trials' density the one that it makes likeliest against the bad trials'."""
    by = ranked(trials)
    cut = min(math.ceil(plan.good * len(by)), plan.most_good)
    out = {}
    for name, (low, high, log) in ranges.items():
        ends = span(low, high, log)
        value = lambda some: np.array([math.log(t.params[name]) if log else float(t.params[name]) for t in some])
        good, bad = (Density(value(some), *ends) for some in (by[:cut], by[cut:]))
        drawn = good.draw(rng, plan.candidates)
        out[name] = back(drawn[int(np.argmax(good.log(drawn) - bad.log(drawn)))], low, high, log)
    return out


def next_batch(trials: list[Trial], plan: Plan = Plan(), ranges: dict = RANGES) -> list[Trial]:
    """The trials to come, all drawn from what has ended so far; a trial has a generator of its own."""
    out = []
    for k in range(len(trials), min(len(trials) + plan.batch, plan.trials)):
        rng = np.random.default_rng([plan.seed, k])
        out.append(Trial(k, draw_at_random(rng, ranges) if k < plan.random or not any(t.scores for t in trials) else draw_guided(rng, trials, plan, ranges)))
    return out


def report(trial: Trial, ratio: float, ended: list[Trial], plan: Plan) -> bool:
    """Adds a fold's ratio; whether the trial goes on. It ends where its best score so far is above the median, at this fold, of the trials that finished in earlier batches."""
    trial.ratios.append(ratio)
    trial.scores.append(float(np.mean(trial.ratios[-plan.recent :])))
    step = len(trial.scores)
    others = [t.scores[step - 1] for t in ended if not t.pruned and len(t.scores) >= step]
    if step >= plan.warmup and len(others) >= plan.finished and min(trial.scores) > float(np.median(others)):
        trial.pruned = True
    return not trial.pruned


def fold_ratios(spark: SparkSession, rows: DataFrame, d: int, some: list[Trial], folds: list[tuple[int, int, int]], first: int) -> dict[tuple[int, int], float]:
    """By (trial, fold) the squared error over that of predicting 0, 1 where that is 0 or no target is known; one job. Folds are (start, start of validation, end), numbered from first."""
    made = [(i * len(folds) + k, t, first + k, *f) for i, t in enumerate(some) for k, f in enumerate(folds)]
    tasks = spark.createDataFrame([(m[0], m[3], m[5], m[4]) for m in made], "fit int, lo long, hi long, mid long")
    own = models.dealt(rows, tasks).withColumn("learn", F.col("row_id") < F.col("mid")).select("fit", "row_id", "x", "y", "learn")
    widest = max((hi - lo) * d for lo, _, hi in folds)
    guesses = models.fit_each(spark, own, {m[0]: Trees(**m[1].params) for m in made}, d, widest).where("row_id IS NOT NULL").select("fit", "row_id", "yhat")
    truth = rows.select("row_id", "y")
    sums = guesses.join(truth, "row_id").groupBy("fit").agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("mse"), F.avg(F.pow("y", F.lit(2))).alias("zero")).collect()
    by = {r.fit: round(r.mse / r.zero, 12) if r.zero > 0 else 1.0 for r in sums}  # rounded, as sums come in any order
    return {(m[1].number, m[2]): by.get(m[0], 1.0) for m in made}


def param_search(spark: SparkSession, rows: DataFrame, d: int, n: int, plan: Plan = Plan(), train: int = 752, val: int = 21, step: int = 21, ranges: dict = RANGES) -> DataFrame:
    """(trial, params as JSON, ratio, folds, pruned, ratios, best): of each trial the score after its last fold, and the ratio of each fold.

    rows is (row_id, x, y) of the core alone, dense from 0 to n, y what trees are to learn. A trial's score is
    the mean ratio of its last `recent` folds so far. best is the finished trial of the lowest score, ties to the
    earlier one. Without a whole fold no trial has a score.
    """
    tables = Tables(spark)
    rows = tables.save(rows.where("y IS NOT NULL"), "rows")  # read by every stage
    folds = [(k * step, train + k * step, train + k * step + val) for k in range(max(0, (n - train - val) // step + 1))]
    trials: list[Trial] = []
    while batch := next_batch(trials, plan, ranges):
        left = list(batch)
        for at in range(0, len(folds), plan.stage):
            if not left:
                break
            part = folds[at : at + plan.stage]
            got = fold_ratios(spark, rows, d, left, part, at)
            left = [t for t in left if all(report(t, got[t.number, at + k], trials, plan) for k in range(len(part)))]
        trials += batch
    tables.drop(rows)
    best = next((t.number for t in ranked(trials) if not t.pruned), None)
    done = [(t.number, json.dumps(t.params), t.scores[-1] if t.scores else None, len(t.scores), t.pruned, t.ratios, t.number == best) for t in trials]
    return spark.createDataFrame(done, "trial int, params string, ratio double, folds int, pruned boolean, ratios array<double>, best boolean")
