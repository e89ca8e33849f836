"""Row-wise rules: guarded arithmetic, indicators, first-wins argmax, label recoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strategy names, label spellings and label codes.
BH, MOM, MR = "Buy & Hold", "Momentum", "Mean Reversion"
STRATEGIES = (BH, MOM, MR)
SNAKE_LABELS = ("buy_hold", "momentum", "mean_reversion")
CODES_BH_MOM_MR = {BH: 0, MOM: 1, MR: 2}
CODES_BH_MR_MOM = {BH: 0, MR: 1, MOM: 2}


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, missing where b is zero."""
    return F.try_divide(as_col(a), as_col(b))


def excess_ratio(a: str | Column, b: str | Column) -> Column:
    return ratio(a, b) - F.lit(1.0)


def indicator(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is missing."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def clip_below(c: str | Column, bound: float = 0.0) -> Column:
    """max(c, bound) that keeps a missing value missing (``greatest`` would drop it)."""
    c = as_col(c)
    return F.when(c < bound, F.lit(bound)).otherwise(c)


def clip_above(c: str | Column, bound: float = 0.0) -> Column:
    c = as_col(c)
    return F.when(c > bound, F.lit(bound)).otherwise(c)


def row_max(columns: Sequence[str | Column]) -> Column:
    return F.greatest(*[as_col(c) for c in columns])


def first_argmax(named: Mapping[str, str | Column]) -> Column:
    """Name of the largest column; the first listed wins ties, all missing gives NULL."""
    best = row_max(list(named.values()))
    branches = [(as_col(c) == best, name) for name, c in named.items()]
    head, *rest = branches
    chain = F.when(head[0], F.lit(head[1]))
    return reduce(lambda acc, b: acc.when(b[0], F.lit(b[1])), rest, chain)


def recode(c: str | Column, mapping: Mapping) -> Column:
    """Dictionary lookup as a CASE; values outside the mapping become NULL."""
    c = as_col(c)
    items = list(mapping.items())
    chain = F.when(c == F.lit(items[0][0]), F.lit(items[0][1]))
    return reduce(lambda acc, kv: acc.when(c == F.lit(kv[0]), F.lit(kv[1])), items[1:], chain)


def pick(choice: str | Column, named: Mapping[str, str | Column], default: str | Column) -> Column:
    """Value of the column that ``choice`` names, else the default."""
    choice = as_col(choice)
    items = list(named.items())
    chain = F.when(choice == F.lit(items[0][0]), as_col(items[0][1]))
    chain = reduce(lambda acc, kv: acc.when(choice == F.lit(kv[0]), as_col(kv[1])), items[1:], chain)
    return chain.otherwise(as_col(default))


def infer_choice(realised: str | Column, named: Mapping[str, str | Column], tol: float = 1e-10) -> Column:
    """Which strategy a realised return came from, tested in listed order and before cash."""
    realised = as_col(realised)
    chain = F.when(realised.isNull(), F.lit("None"))
    for name, c in named.items():
        chain = chain.when(F.abs(as_col(c) - realised) < tol, F.lit(name))
    return chain.when(F.abs(realised) < tol, F.lit("Cash/0")).otherwise(F.lit("Unknown"))


def number(c: str | Column) -> Column:
    """Text to DOUBLE, missing when it does not parse."""
    return as_col(c).try_cast("double")


# Forms of dates in price files besides ISO ones; where day and month could be swapped, the month is first.
DATE_FORMS = ("M/d/yyyy", "yyyy/M/d", "M-d-yyyy", "d.M.yyyy", "yyyyMMdd", "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy")


def day(c: str | Column) -> Column:
    """Text to DATE in ISO form or one of the listed forms, missing when none fits."""
    c = F.trim(as_col(c))
    return F.coalesce(c.try_cast("date"), *[F.try_to_date(c, form) for form in DATE_FORMS])
