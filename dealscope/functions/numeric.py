"""Null-aware numeric expressions; every one is a built-in column expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def within(c: Column | str, low: float, high: float) -> Column:
    """low <= c <= high; false, not null, where c is null."""
    return F.coalesce(col(c).between(low, high), F.lit(False))


def flag(condition: Column) -> Column:
    """A condition with unknown as false."""
    return F.coalesce(condition, F.lit(False))


def bands(c: Column | str, edges: Sequence[tuple[str, float, float]]) -> dict[str, Column]:
    """One 0/1 column for each (name, low, high): low <= c < high; 0 where c is null."""
    return {name: flag((col(c) >= low) & (col(c) < high)).cast("int") for name, low, high in edges}


def first_failing(rules: Sequence[tuple[str, Column]], ok: str = "") -> Column:
    """Name of the first rule whose condition holds, else ``ok``."""
    if not rules:
        return F.lit(ok)
    (name, rule), *rest = rules
    chain = reduce(lambda acc, r: acc.when(flag(r[1]), r[0]), rest, F.when(flag(rule), name))
    return chain.otherwise(ok)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limited to [low, high]; null stays null."""
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(col(c).isNotNull(), out)


def missing(c: Column | str) -> Column:
    return col(c).isNull().cast("int")


def truth(c: Column | str) -> Column:
    """1 where true, 0 where false or unknown."""
    return flag(col(c)).cast("int")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where either is null or b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def log_positive(c: Column | str) -> Column:
    return F.when(col(c) > 0, F.ln(col(c)))


def age(year: Column | str, built: Column | str) -> Column:
    return F.when(col(year).isNotNull() & col(built).isNotNull(), F.greatest(F.lit(0), col(year) - col(built)))


def iso_year(c: Column | str) -> Column:
    return F.substring(col(c).cast("string"), 1, 4).try_cast("int")


def bucket(c: Column | str, limits: Sequence[tuple[float, str]], above: str) -> Column:
    """Label of the first limit that c does not exceed; null stays null."""
    out = F.when(col(c).isNull(), F.lit(None).cast("string"))
    for limit, label in limits:
        out = out.when(col(c) <= limit, label)
    return out.otherwise(above)


#: Size classes by floor area.
ROOM_LIMITS = ((30, "studio"), (45, "1-room"), (65, "2-room"), (90, "3-room"))


def rooms_bucket(area: Column | str) -> Column:
    return bucket(area, ROOM_LIMITS, "4+room")


def scaled(c: Column | str, factor: float, kind: str = "bigint") -> Column:
    """Half-even rounded integer of c * factor; null stays null."""
    return F.bround(col(c) * F.lit(float(factor)), 0).cast(kind)


def index_in(c: Column | str, domain: Sequence[str]) -> Column:
    """Place in ``domain`` from 0, -1 where null; a value outside it raises."""
    place = F.array_position(F.array(*[F.lit(d) for d in domain]), col(c)).cast("int") - 1
    unseen = F.raise_error(F.concat(F.lit("value outside the domain: "), col(c)))
    return F.when(col(c).isNull(), -1).when(place >= 0, place).otherwise(unseen.cast("int"))


def key_of(*parts: Column | str, sep: str = "|") -> Column:
    """Parts joined as text; a null part becomes the text nan."""
    return F.concat_ws(sep, *[F.coalesce(col(p).cast("string"), F.lit("nan")) for p in parts])


def row_mean(*cols: Column | str) -> Column:
    """Mean of the non-null ones; null if all are null."""
    some = F.array_compact(F.array(*[col(c).cast("double") for c in cols]))
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


def relative(price: Column | str, average: Column | str) -> Column:
    return ratio(price, average)


def relative_columns(price: str, average: str, n: str, suffix: str = "", least: int = 3) -> dict[str, Column]:
    """Ratio to the neighbourhood, its difference from 1, and whether enough neighbours back it."""
    r = ratio(price, average)
    return {f"spatial_price_ratio{suffix}": r, f"spatial_price_pct_vs_avg{suffix}": r - 1, f"spatial_rank_reliable{suffix}": F.coalesce(F.col(n), F.lit(0)) >= least}


def standard_error(sigma: float | Column, n_eff: Column | str) -> Column:
    return (F.lit(sigma) if isinstance(sigma, float) else sigma) * F.sqrt(1 + 1 / F.greatest(col(n_eff), F.lit(1.0)))
