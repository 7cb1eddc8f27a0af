"""The whole run in one call: from the raw daily table to feature lists, a searched and walked-forward model, its score and a record.

Each stage's columns are known only once the stage before it is done: the build makes them, the screens and the
importances thin them, the cuts choose those of the trees and of the line. A stage is written aside and published by
one rename, so that what is there is whole; a run that was ended is called again and goes on after its last stage.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import build, models, screening, search, selection
from ..operators.boosting import Trees
from ..sources import files

#: The columns that the position rule reads, and its settings.
RULE = {"vol": "lagged_forward_returns_std21", "mom": "lagged_forward_returns_mean21"}
POSITIONS = {"K": 6.0, "max_leverage": 2.0, "min_leverage": 0.0, "vol_col": RULE["vol"], "mom_col": RULE["mom"], "vol_floor": 1e-4, "crash_mom_threshold": -0.0005}


@dataclass(frozen=True)
class Settings:
    """Of a run. Rows from the last `hold` on serve for the score alone: screens, importances, the offline line and the search see core rows.

    bound is the importance that a feature of the line must reach, of so many trees as counted has; share that
    part of all importance that the trees' features hold.
    """

    build: build.Build = build.Build()
    hold: int = models.HOLD
    missing: float = 0.98
    spread: float = 1e-12
    corr: float = 0.98
    sample: int | None = None
    counted: Trees = field(default_factory=lambda: models.COUNTED)
    splits: int = 5
    share: float = 0.95
    bound: float = 260.0
    plan: search.Plan = search.Plan()
    ranges: dict = field(default_factory=lambda: search.RANGES)
    train: int = 752
    val: int = 21
    step: int = 21
    refit: int = models.REFIT
    window: int = models.TREE_ROWS

    def mark(self) -> str:
        own = {**asdict(self), "counted": self.counted.settings()}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]


class Stages:
    """Tables under a root that every executor sees, by name; made once, and read from then on."""

    def __init__(self, spark: SparkSession, root: str, mark: str):
        self.spark, self.root, self.made = spark, root.rstrip("/"), []
        own = self.table("settings", lambda: spark.createDataFrame([(mark,)], "mark string")).first().mark
        if own != mark:
            raise ValueError(f"{root} holds a run with other settings")

    def path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark._jsc.sc().hadoopConfiguration())

    def published(self, name: str) -> bool:
        p, fs = self.path(name)
        return fs.exists(p)

    def publish(self, name: str, write: Callable[[str], None]) -> None:
        """write(path) to a folder aside, which then gets the name; nothing is done where the name is there."""
        if self.published(name):
            return
        aside = f"_making-{uuid.uuid4().hex}"
        write(f"{self.root}/{aside}")
        (to, fs), (made, _) = self.path(name), self.path(aside)
        if not fs.rename(made, to) and not fs.exists(to):
            raise OSError(f"could not publish {to}")
        self.made.append(name)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        self.publish(name, lambda at: make().write.parquet(at))
        return self.spark.read.parquet(f"{self.root}/{name}")


def run(spark: SparkSession, raw: DataFrame, root: str, settings: Settings = Settings()) -> dict:
    """The record of the run over raw (row_id, groups' columns, labels), which is also written, with all it rests on, under root.

    Tables: features, screen, importance, trees_on and line_on (feature, importance), line, trials, forward (row_id,
    linear, offline, hybrid), scores; lists in CSV: lgbm_selected_main_features, linear_main_features; models:
    linear_model, linear_scaler; the record: results. Raises ValueError where the root holds a run with other
    settings, or no feature reaches the bound.
    """
    s, stages = settings, Stages(spark, root, settings.mark())
    features = stages.table("features", lambda: build.build_features(raw, s.build))
    n = features.agg(F.max("row_id")).first()[0] + 1
    core_end = n - s.hold
    core = features.where(F.col("row_id") < core_end)
    target = features.where(F.col("feature") == "forward_returns").select("row_id", F.col("value").alias("y"))
    main = core.where(F.col("feature").rlike(selection.MAIN))

    screen = stages.table("screen", lambda: screening.screen_report(main, s.missing, s.spread, s.corr, s.sample))
    kept = sorted(r.feature for r in screen.where("reason IS NULL").collect())
    importance = stages.table("importance", lambda: models.tree_importance(spark, models.vectors(core, kept).join(target, "row_id"), kept, core_end, s.splits, s.counted))
    trees_on = stages.table("trees_on", lambda: screening.importance_cut(importance, s.share).select("feature", "importance"))
    line_on = stages.table("line_on", lambda: screening.importance_at_least(importance, s.bound))
    for name, chosen in (("lgbm_selected_main_features", trees_on), ("linear_main_features", line_on)):
        stages.publish(name, lambda at, c=chosen: files.write_feature_list(c, at))
    of_trees, of_line = (sorted(r.feature for r in x.collect()) for x in (trees_on, line_on))
    if not of_line:
        raise ValueError(f"no feature reaches an importance of {s.bound}")

    line_rows = stages.table("line_rows", lambda: models.line_rows(features, of_line, core_end))
    tree_rows = stages.table("tree_rows", lambda: models.vectors(features, of_trees))
    fitted = stages.table("line", lambda: spark.createDataFrame([_line(line_rows.join(target, "row_id"), core_end, len(of_line))], "w array<double>, c double")).first()
    left = line_rows.where(F.col("row_id") < core_end).join(target, "row_id").select("row_id", (F.col("y") - models.dot("x", fitted.w, fitted.c)).alias("y"))
    trials = stages.table("trials", lambda: search.param_search(spark, tree_rows.join(left, "row_id"), len(of_trees), core_end, s.plan, s.train, s.val, s.step, s.ranges))
    best = json.loads(trials.where("best").first().params)

    carried = lambda: models.vectors(models.carried(features.where(F.col("feature").isin(of_trees))), of_trees)
    forward = stages.table("forward", lambda: models.walk_forward(spark, line_rows, carried(), target, n, (len(of_line), len(of_trees)), Trees(**best), hold=s.hold, refit=s.refit, window=s.window))
    days = build.to_wide(features, ["forward_returns", "risk_free_rate", *RULE.values()])
    scores = stages.table("scores", lambda: models.walk_forward_scores(forward, days, **RULE))

    by = {r["model"]: {k: v for k, v in r.asDict().items() if k not in ("model", "n_days")} for r in scores.collect()}
    record = {
        "best_lgbm_params": best, "pos_params": POSITIONS, "hold_adj_sharpe_hybrid": by["hybrid"].pop("adjusted_sharpe"), "hold_components_hybrid": by["hybrid"],
        "hold_adj_sharpe_linear": by["offline"].pop("adjusted_sharpe"), "hold_components_linear": by["offline"],
    }
    stages.publish("results", lambda at: spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(at))
    stages.publish("linear_model", lambda at: files.save_fitted(spark, {"columns": of_line, "weights": list(fitted.w), "intercept": fitted.c}, at))
    stages.publish("linear_scaler", lambda at: files.save_fitted(spark, _scaler(features, of_line, core_end), at))
    return record


def _line(rows: DataFrame, core_end: int, d: int) -> tuple[list[float], float]:
    w, c = models.core_line(rows, core_end, d)
    return w.tolist(), c


def _scaler(features: DataFrame, columns: list[str], core_end: int) -> dict:
    """Means and deviations of the core rows' carried values; the imputer that comes before it carries values forward and puts 0 before the first."""
    filled = models.carried(features.where(F.col("feature").isin(columns))).where(F.col("row_id") < core_end)
    found = {r.feature: r for r in filled.groupBy("feature").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("m"), F.stddev_pop(F.coalesce("value", F.lit(0.0))).alias("s")).collect()}
    return {"columns": columns, "mean": [found[c].m for c in columns], "scale": [found[c].s or 1.0 for c in columns], "imputer": "forward, then 0"}
