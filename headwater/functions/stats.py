"""Mergeable statistics: partials of zones, and their merges over catchments.

A statistic of a catchment is computed from its subbasins' partials alone.
Partial variances are centred on their zone's mean.  Merged variances are taken
about a pivot, the mean of one of the merged zones: what cancels then is no
larger than that zone's own part of the variance.  Registries map the names of
statistics to columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_partials(x: str) -> dict[str, Column]:
    """Of one zone, nulls left out: count, sum, mean, centred squares, min and max."""
    c = F.col(x).cast("double")
    return {f"{x}_n": F.count(c), f"{x}_sum": F.sum(c), f"{x}_mean": F.avg(c), f"{x}_var": F.var_pop(c), f"{x}_min": F.min(c), f"{x}_max": F.max(c)}


def weighted_partials(x: str, w: str, mean: str) -> dict[str, Column]:
    """Of one zone, rows with a null value or weight left out: weight, weighted sum, mean and population variance; ``mean`` is the zone's weighted mean."""
    c, u = F.col(x).cast("double"), F.col(w).cast("double")
    held = F.when(c.isNotNull(), u)
    total = F.nullif(F.sum(held), F.lit(0.0))
    away = c - F.col(mean)
    return {f"{x}_{w}_weight": F.sum(held), f"{x}_{w}_sum": F.sum(c * u), f"{x}_{w}_mean": F.max(mean), f"{x}_{w}_var": F.sum(away * away * u) / total}


def weighted_mean(x: str, w: str) -> Column:
    c, u = F.col(x).cast("double"), F.col(w).cast("double")
    return F.sum(c * u) / F.nullif(F.sum(F.when(c.isNotNull(), u)), F.lit(0.0))


#: Merges of zones' partials n, mean and population variance: name to aggregate.
def merged_mean(n: str, mean: str) -> Column:
    both = F.when(F.col(n).isNotNull() & F.col(mean).isNotNull(), F.col(n))
    return F.sum(both * F.col(mean)) / F.nullif(F.sum(both), F.lit(0.0))


def _about(pivot: str | None) -> Column:
    return F.coalesce(F.col(pivot), F.lit(0.0)) if pivot else F.lit(0.0)


def merged_var_pop(n: str, mean: str, var: str, pivot: str | None = None) -> Column:
    """Sum of n (v + (m - mu)^2) over sum of n, with mu the merged mean.

    ``pivot`` is a column that is constant in a group, the mean of one of its
    zones; without it, means far from 0 lose digits.
    """
    k = F.when(F.col(n).isNotNull() & F.col(mean).isNotNull() & F.col(var).isNotNull(), F.col(n))
    total, away = F.nullif(F.sum(k), F.lit(0.0)), F.col(mean) - _about(pivot)
    shift = F.sum(k * away) / total
    found = F.sum(k * (F.col(var) + away * away)) / total - shift * shift
    return F.when(found < 0, 0.0).otherwise(found)  # greatest() would turn a null into 0


def merged_var_samp(n: str, mean: str, var: str, pivot: str | None = None) -> Column:
    """The population variance times N / (N - 1); null where N is at most 1."""
    total = F.sum(F.when(F.col(n).isNotNull() & F.col(mean).isNotNull() & F.col(var).isNotNull(), F.col(n)))
    return F.when(total > 1, merged_var_pop(n, mean, var, pivot) * total / (total - 1))


def compat_var_samp(n: str, mean: str, var_samp: str, pivot: str | None = None) -> Column:
    """The older convention: partial variances are sample variances yet rescaled by n / (n - 1), and zones of one cell are left out."""
    some = F.col(n) > 1
    k = F.when(some & F.col(mean).isNotNull() & F.col(var_samp).isNotNull(), F.col(n))
    total, away = F.nullif(F.sum(k), F.lit(0.0)), F.col(mean) - _about(pivot)
    shift = F.sum(k * away) / total
    inside = F.sum(F.when(some, (k - 1) * F.col(var_samp) * k / F.nullif(k - 1, F.lit(0))))
    return (inside + F.sum(k * away * away) - total * shift * shift) / F.nullif(total - 1, F.lit(0.0))


NUMERIC: dict[str, Callable[[str], Column]] = {
    "mean": lambda x: merged_mean(f"{x}_n", f"{x}_mean"),
    "sd": lambda x: F.sqrt(merged_var_samp(f"{x}_n", f"{x}_mean", f"{x}_var", f"{x}_pivot")),
    "variance": lambda x: merged_var_samp(f"{x}_n", f"{x}_mean", f"{x}_var", f"{x}_pivot"),
    "min": lambda x: F.min(f"{x}_min"),
    "max": lambda x: F.max(f"{x}_max"),
    "sum": lambda x: F.sum(f"{x}_sum"),
}

WEIGHTED: dict[str, Callable[[str, str], Column]] = {
    "mean": lambda x, w: merged_mean(f"{x}_{w}_weight", f"{x}_{w}_mean"),
    "sd": lambda x, w: F.sqrt(merged_var_pop(f"{x}_{w}_weight", f"{x}_{w}_mean", f"{x}_{w}_var", f"{x}_{w}_pivot")),
    "variance": lambda x, w: merged_var_pop(f"{x}_{w}_weight", f"{x}_{w}_mean", f"{x}_{w}_var", f"{x}_{w}_pivot"),
    "sum": lambda x, w: F.sum(f"{x}_{w}_sum"),
}


def inverse_distance(d: Column) -> Column:
    """The default weight of a distance."""
    return 1.0 / (0.001 * d + 1.0)


#: Weighting schemes: a weight from distance to the stream, distance to the outlet and accumulation.
WEIGHTS: dict[str, Callable[..., Column]] = {
    "lumped": lambda to_stream, to_outlet, accum, stream, f=inverse_distance: F.lit(1.0),
    "iFLS": lambda to_stream, to_outlet, accum, stream, f=inverse_distance: f(to_stream),
    "HAiFLS": lambda to_stream, to_outlet, accum, stream, f=inverse_distance: F.when(~stream, f(to_stream) * (accum + 1)),
    "iFLO": lambda to_stream, to_outlet, accum, stream, f=inverse_distance: f(to_outlet),
    "HAiFLO": lambda to_stream, to_outlet, accum, stream, f=inverse_distance: f(to_outlet) * accum,
}
