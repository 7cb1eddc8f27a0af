"""Which columns an operator takes, by their names: patterns that Python and Spark read alike.

In the wide layout a pattern picks columns, in the long one rows by their feature. A prefix is loose:
MOM1 starts with M as well as with MOM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

#: The columns that are no features, and what derived columns are named.
IDS, LABELS, TARGET = ("date_id", "row_id", "is_scored"), ("forward_returns", "risk_free_rate", "market_forward_excess_returns"), "excess_returns"
#: Everything but ids, labels, the target, lags, interactions and components.
BASE = rf"^(?!(?:{'|'.join((*IDS, *LABELS, TARGET))})$)(?!lagged_|XINT_)(?!.*_pc1$)(?!.*_pc1_)"
#: Everything but ids, labels and the target; lags are features.
MAIN = rf"^(?!(?:{'|'.join((*IDS, *LABELS, TARGET))})$)"
#: Columns that the first-valid filter never drops.
EXCLUDED = rf"^(?:(?:{'|'.join((*IDS, *LABELS))})$|lagged_)"
#: Columns that the test set shows ten days late.
LATE_BLOCK = r"^[ES]"


def matching(names: Iterable[str], pattern: str) -> list[str]:
    """Those of names that the pattern is found in, in their order."""
    return [n for n in names if re.search(pattern, n)]


def numeric(df: DataFrame, pattern: str, booleans: bool = True) -> list[str]:
    """Numeric columns whose name the pattern matches, in their order; booleans count as numbers unless told otherwise."""
    kinds = (NumericType, BooleanType) if booleans else (NumericType,)
    return matching((f.name for f in df.schema.fields if isinstance(f.dataType, kinds)), pattern)


def base_columns(df: DataFrame) -> list[str]:
    """The columns that rolling features are made of."""
    return numeric(df, BASE)


def main_columns(df: DataFrame) -> list[str]:
    """The columns that models may take."""
    return numeric(df, MAIN, booleans=False)


def is_excluded(feature: Column) -> Column:
    """Whether the first-valid filter leaves a feature alone."""
    return feature.rlike(EXCLUDED)


def z_scores(plan: dict[str, tuple[int, ...]]) -> str:
    """The pattern of z-scores of each (prefix, window) of a plan."""
    return "^(?:" + "|".join(f"{prefix}.*_z{w}" for prefix, windows in plan.items() for w in windows) + ")$"


def group_members(prefix: str, window: int = 21) -> str:
    """The pattern of a group's z-scores, of which its component is made."""
    return z_scores({prefix: (window,)})


def literal_means(groups: tuple[str, ...] = ("P", "I", "S"), whole_group: bool = False) -> str:
    """The pattern of the means to drop: of columns named P_…, I_… or S_…, not P1_…; with whole_group, of every column of the groups."""
    return f"^(?:{'|'.join(groups)}){'.*' if whole_group else '(?:_.*)?'}_mean"
