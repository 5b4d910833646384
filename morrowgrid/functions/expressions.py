"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"


def cents(c) -> Column:
    """Money with two decimals as an exact decimal, so that sums don't depend on order."""
    return F.col(c).cast(CENTS) if isinstance(c, str) else c.cast(CENTS)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(pred: Column) -> Column:
    """Share of rows where pred holds; rows where it is unknown don't count."""
    return ratio(F.count_if(pred), F.count(pred))


def rate(c: str) -> Column:
    """Mean of a 0/1 column from exact counts."""
    return ratio(F.sum(F.col(c).cast("long")), F.count(c))


def r6(c: Column) -> Column:
    """Six decimals, half up."""
    return F.round(c, 6)


def scaled_round(c: Column, digits: int) -> Column:
    """Half away from zero on c * 10^digits, as SQL engines on doubles do; what a negative number rounds to keeps its sign, so -0.04 gives -0.0, as does -0.0."""
    x, scale = c * F.lit(10.0**digits), F.lit(10.0**digits)
    return F.when(x < 0, F.negative(F.round(F.negative(x), 0))).when(x == 0, x).otherwise(F.round(x, 0)) / scale


def cut_bins(c: Column, edges: list[float]) -> Column:
    """Right-closed bin number from 0; values outside (edges[0], edges[-1]] are null."""
    out = F.when(c.isNull(), None)
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = out.when((c > lo) & (c <= hi), i)
    return out.cast("int")


def edge_bins(c: Column, edges: Column) -> Column:
    """Right-closed bin number from 0 against an array of ascending edges; the lowest edge belongs to bin 0."""
    below = F.size(F.filter(edges, lambda e: e < c))
    return F.when(c.isNull(), None).otherwise(F.greatest(below - 1, F.lit(0))).cast("int")


def clip(c: Column, low=None, high=None) -> Column:
    """Clip that keeps nulls null."""
    out = c
    if low is not None:
        out = F.when(c.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(c.isNotNull(), F.least(out, F.lit(high)))
    return out


def lookup(key: Column, table: dict) -> Column:
    """Value of a literal map; a missing key gives null."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)


def case_when(branches: list[tuple[Column, object]], default=None) -> Column:
    """The first branch that holds."""
    out = None
    for p, v in branches:
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(p, v) if out is None else out.when(p, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def keyed_hash(key: Column, modulus: int = 1000) -> Column:
    """A multiplicative hash that any SQL engine computes alike; splits and folds use it."""
    return (key.cast("long") * F.lit(2654435761)) % F.lit(modulus)


def base_feature(name: Column, categorical: list[str]) -> Column:
    """The source column of an encoded feature name such as cat__geo_Germany or num__age."""
    plain = F.regexp_replace(name, "^(num|cat)__", "")
    hit = None
    for c in categorical:
        hit = F.when(plain.startswith(f"{c}_"), F.lit(c)) if hit is None else hit.when(plain.startswith(f"{c}_"), F.lit(c))
    return hit.otherwise(plain) if hit is not None else plain


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def currency(c: Column, sign: str = "€") -> Column:
    return F.concat(F.lit(sign), F.format_number(c, 0))
