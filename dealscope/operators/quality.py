"""Checks that raise, and the figures behind them.

Where a table is written anyway, its checks and counts are observed on the way (:func:`observed`, :func:`stored_checked`); the other
functions are for tables that are not, and take a pass of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dealscope.session import stored


class CheckFailed(ValueError):
    """A data check did not hold."""


def require(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df``, after each condition was found to hold on every row (null counts as not)."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]).first()
    if bad := {k: row[k] for k in checks if row[k]}:
        raise CheckFailed(f"rows that fail: {bad}")
    return df


def observed(df: DataFrame, name: str, values: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """``df`` as a stored table, and the aggregates ``values`` of its rows, taken while it is written.

    They are observed where the rows are written, so a task that is run again counts once.
    """
    watch = Observation(f"{name}-{uuid.uuid4().hex}")
    out = stored(df.observe(watch, *[v.alias(k) for k, v in values.items()]), name)
    return out, dict(watch.get)


def stored_checked(df: DataFrame, name: str, checks: Mapping[str, Column] | None = None, rows: int | None = None, figures: Mapping[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """``df`` as a stored table, after each condition held on every row (null counts as not) and it had ``rows`` rows, if given.

    Nothing is read again for it.  Returns the table and its figures, ``rows`` among them.
    """
    bad = {f"__bad_{k}": F.count_if(~F.coalesce(c, F.lit(False))) for k, c in (checks or {}).items()}
    out, got = observed(df, name, {"rows": F.count("*"), **bad, **(figures or {})})
    if failed := {k[6:]: v for k, v in got.items() if k in bad and v}:
        raise CheckFailed(f"rows that fail: {failed}")
    if rows is not None and got["rows"] != rows:
        raise CheckFailed(f"{rows} rows became {got['rows']}")
    return out, {k: v for k, v in got.items() if k not in bad}


def require_count(df: DataFrame, expected: int, what: str = "rows") -> DataFrame:
    if (n := df.count()) != expected:
        raise CheckFailed(f"{n} {what}, not {expected}")
    return df


def require_no_loss(before: DataFrame, after: DataFrame, dropped: int = 0) -> DataFrame:
    if (a := before.count()) != (b := after.count()) + dropped:
        raise CheckFailed(f"{a} rows became {b} with {dropped} accounted for")
    return after


def require_categories(df: DataFrame, c: str, expected: Sequence[str]) -> DataFrame:
    """``df``, if the non-null values of c are exactly the expected ones."""
    found = {r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(len(expected) + 1).collect()}
    if found != set(expected):
        raise CheckFailed(f"{c}: unexpected {sorted(found - set(expected))}, absent {sorted(set(expected) - found)}")
    return df


def exactly_one(*indicators: Column | str) -> Column:
    """Whether just one of the 0/1 columns is 1."""
    total = F.lit(0)
    for i in indicators:
        total = total + (F.col(i) if isinstance(i, str) else i)
    return total == 1
