"""Queries of zonal statistics, merges and weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from headwater.functions.stats import WEIGHTS, merged_mean, merged_var_pop, merged_var_samp
from headwater.operators import distance, weights, zonal
from headwater.plans.views import CELLS, CLOSURE, LINKS, cells, links

FLAGS = ["A", "N", "R"]


def r(n, c, places=7):
    return F.round(c, places).alias(n)


def single(n, c):
    """To the 24 bits of a single float: variances of whole numbers are often exact halves of a decimal place, which rounding to decimals would split."""
    return c.cast("float").cast("double").alias(n)


def places_of(name):
    """Decimals to compare: plain means of two-decimal values often end in an exact half, weighted ones carry rounding errors."""
    return 9 if name.endswith("mean") and "iFLS" not in name else 4


def chunks(spark, d):
    """Partials of num_a by zone and batch (the category), as a merge's input."""
    partials = zonal.zone_partials(cells(spark, d).withColumn("zone", F.struct("link_id", "cat")), "zone", ["num_a"], {}, ["w"])
    names = {"n": "num_a_n", "m": "num_a_mean", "v": "num_a_var", "ww": "num_a_w_weight", "wm": "num_a_w_mean", "wv": "num_a_w_var"}
    return partials.select("zone.link_id", *[F.col(c).cast("double").alias(k) for k, c in names.items()])


def by_chunk(aggregate):
    """Merges by zone; the pivot is the least mean of a zone's chunks, found on the rows that the merge groups anyway."""
    one = lambda: Window.partitionBy("link_id")
    return lambda s, d: chunks(s, d).withColumns({"p": F.min("m").over(one()), "wp": F.min("wm").over(one())}).groupBy("link_id").agg(*aggregate())


def flagship(spark, d):
    some = cells(spark, d).withColumnRenamed("w", "iFLS")
    partials = zonal.zone_partials(some, "link_id", ["num_a", "num_b"], {"cat": FLAGS}, ["iFLS"])
    out = zonal.merge_over(distance.link_closure(links(spark, d)), partials, "link_id", ["num_a", "num_b"], {"cat": FLAGS}, ["iFLS"])
    return out.select("link_id", *[r(c, F.col(c), places_of(c)) for c in out.columns if c != "link_id"])


def quantiles(spark, d):
    out = zonal.catchment_quantiles(distance.link_closure(links(spark, d)), cells(spark, d), "link_id", "num_a", [0.25, 0.5, 0.75])
    return out.select("link_id", *[r(c, F.col(c)) for c in out.columns if c != "link_id"])


def zone_min(spark, d):
    near = cells(spark, d).groupBy(F.col("link_id").alias("origin")).agg(F.min("dist").alias("m"))
    return distance.link_closure(links(spark, d)).join(near, "origin").groupBy(F.col("destination").alias("link_id")).agg(r("min_dist", F.min("m")))


def outlet_weights(spark, d):
    """iFLO and HAiFLO summed over each catchment, by cell; the weights stay long, keyed by pour point and cell."""
    pairs = distance.link_closure(links(spark, d))
    some = cells(spark, d).withColumnRenamed("link_id", "origin")
    away = weights.outlet_distance(pairs, some, "dist")
    weight = lambda n: WEIGHTS[n](F.col("dist"), F.col("to_outlet"), F.col("accum"), F.lit(False))
    return away.groupBy(F.col("destination").alias("link_id")).agg(r("iFLO", F.sum(weight("iFLO")), 3), r("HAiFLO", F.sum(weight("HAiFLO")), 3))


def stream_weights(spark, d):
    some = cells(spark, d)
    weight = lambda n: WEIGHTS[n](F.col("dist"), F.lit(0.0), F.col("accum"), F.col("cat") == "R")
    return some.groupBy("link_id").agg(*[r(n, F.sum(weight(n))) for n in ("lumped", "iFLS", "HAiFLS")])


def zones(*columns):
    return lambda s, d: cells(s, d).groupBy("link_id").agg(*[c() for c in columns])


def sql(*columns, source="cells", key="link_id"):
    return f"WITH {CELLS} SELECT {key}, {', '.join(columns)} FROM {source} GROUP BY {key}"


CHUNKS = f"WITH {CELLS}, k AS (SELECT link_id, cat, CAST(count(num_a) AS DOUBLE) AS n, avg(num_a) AS m FROM cells GROUP BY 1, 2)"
CENTRED = f"WITH {CELLS}, c AS (SELECT *, sum(w * num_a) OVER (PARTITION BY link_id) / sum(w) OVER (PARTITION BY link_id) AS mu FROM cells)"
STATS = [("mean", "avg({})"), ("sd", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})"), ("sum", "sum({})")]
CATCH = f"WITH RECURSIVE {LINKS}, {CLOSURE}, {CELLS}, z AS (SELECT c.destination, x.* FROM cl c JOIN cells x ON c.origin = x.link_id)"
FLAG_SQL = CATCH + " SELECT destination AS link_id, " + ", ".join(
    [f"round({f.format(x)}, {places_of(n)}) AS {x}_lumped_{n}" for x in ("num_a", "num_b") for n, f in STATS]
    + [f"round(sum(w * {x}) / sum(w) FILTER ({x} IS NOT NULL), 4) AS {x}_iFLS_mean, round(sqrt(greatest(sum(w * {x} * {x}) / sum(w) FILTER ({x} IS NOT NULL) - pow(sum(w * {x}) / sum(w) FILTER ({x} IS NOT NULL), 2), 0)), 4) AS {x}_iFLS_sd, round(sum(w * {x}), 4) AS {x}_iFLS_sum" for x in ("num_a", "num_b")]
    + [f"round(count(*) FILTER (cat = '{v}') / count(*), 4) AS cat_{v}_lumped_prop, round(coalesce(sum(w) FILTER (cat = '{v}'), 0) / sum(w), 4) AS cat_{v}_iFLS_prop" for v in FLAGS]
) + " FROM z GROUP BY 1"

QUERIES = {
    "AGG7_zone_stats": (
        zones(lambda: r("s", F.sum(F.col("num_b"))), lambda: r("m", F.avg(F.col("num_b"))), lambda: r("sd", F.stddev_samp(F.col("num_b"))), lambda: r("v", F.var_samp(F.col("num_b")), 6), lambda: F.count(F.col("num_b")).alias("n"), lambda: F.min(F.col("num_b")).alias("lo"), lambda: F.max(F.col("num_b")).alias("hi")),
        sql("round(sum(num_b), 7) AS s", "round(avg(num_b), 7) AS m", "round(stddev_samp(num_b), 7) AS sd", "round(var_samp(num_b), 6) AS v", "count(num_b) AS n", "min(num_b) AS lo", "max(num_b) AS hi"),
    ),
    "AGG8_cell_count": (zones(lambda: F.count(F.lit(1)).alias("n")), sql("count(*) AS n")),
    "AGG9_category_presence": (zones(*[lambda v=v: F.count_if(F.col("cat") == v).alias(f"cat_{v}") for v in FLAGS]), sql(*[f"count(*) FILTER (cat = '{v}') AS cat_{v}" for v in FLAGS])),
    "AGG10_weight_sum": (zones(lambda: r("w", F.sum(F.col("w")), 6)), sql("round(sum(w), 6) AS w")),
    "AGG11_weighted_mean": (zones(lambda: r("m", F.sum(F.col("num_b") * F.col("w")) / F.nullif(F.sum(F.when(F.col("num_b").isNotNull(), F.col("w"))), F.lit(0.0)), 6)), sql("round(sum(num_b * w) / nullif(sum(w) FILTER (num_b IS NOT NULL), 0), 6) AS m")),
    "AGG12_weighted_variance": (
        lambda s, d: zonal.zone_partials(cells(s, d), "link_id", ["num_b"], {}, ["w"]).select("link_id", r("v", F.col("num_b_w_var"), 8)),
        sql("round(sum(w * num_b * num_b) / nullif(sum(w) FILTER (num_b IS NOT NULL), 0) - pow(sum(num_b * w) / nullif(sum(w) FILTER (num_b IS NOT NULL), 0), 2), 8) AS v"),
    ),
    "AGG13_weighted_sum": (zones(lambda: r("s", F.sum(F.col("num_b") * F.col("w")), 6)), sql("round(sum(num_b * w), 6) AS s")),
    "AGG14_weight_of_values": (zones(lambda: r("w", F.sum(F.when(F.col("num_b").isNotNull(), F.col("w"))), 6)), sql("round(sum(w) FILTER (num_b IS NOT NULL), 6) AS w")),
    "AGG15_merged_mean": (by_chunk(lambda: [r("m", merged_mean("n", "m"))]), f"{CHUNKS} SELECT link_id, round(sum(n * m) / sum(n), 7) AS m FROM k GROUP BY 1"),
    "AGG16_merged_variance": (
        by_chunk(lambda: [single("v", merged_var_pop("n", "m", "v", "p")), single("sd", F.sqrt(merged_var_pop("n", "m", "v", "p")))]),
        f"WITH {CELLS} SELECT link_id, CAST(CAST(var_pop(num_a) AS FLOAT) AS DOUBLE) AS v, CAST(CAST(stddev_pop(num_a) AS FLOAT) AS DOUBLE) AS sd FROM cells GROUP BY 1",
    ),
    "AGG17_merged_sample_variance": (by_chunk(lambda: [r("v", merged_var_samp("n", "m", "v", "p"), 9), r("sd", F.sqrt(merged_var_samp("n", "m", "v", "p")), 9)]), f"WITH {CELLS} SELECT link_id, round(var_samp(num_a), 9) AS v, round(stddev_samp(num_a), 9) AS sd FROM cells GROUP BY 1"),
    "AGG18_merged_weighted_mean": (by_chunk(lambda: [r("m", merged_mean("ww", "wm"))]), f"WITH {CELLS} SELECT link_id, round(sum(num_a * w) / sum(w), 7) AS m FROM cells GROUP BY 1"),
    "AGG19_merged_weighted_variance": (by_chunk(lambda: [r("v", merged_var_pop("ww", "wm", "wv", "wp"))]), f"{CENTRED} SELECT link_id, round(sum(w * (num_a - mu) * (num_a - mu)) / sum(w), 7) AS v FROM c GROUP BY 1"),
    "AGG20_merged_weighted_sample_variance": (by_chunk(lambda: [single("v", merged_var_samp("ww", "wm", "wv", "wp"))]), f"{CENTRED} SELECT link_id, CASE WHEN sum(w) > 1 THEN CAST(CAST(sum(w * (num_a - mu) * (num_a - mu)) / (sum(w) - 1) AS FLOAT) AS DOUBLE) END AS v FROM c GROUP BY 1"),
    "AGG25_catchment_quantiles": (quantiles, CATCH + " SELECT destination AS link_id, round(quantile_cont(num_a, 0.25), 7) AS num_a_lumped_q25, round(median(num_a), 7) AS num_a_lumped_median, round(quantile_cont(num_a, 0.75), 7) AS num_a_lumped_q75 FROM z GROUP BY 1"),
    "AGG26_zone_min": (zone_min, CATCH + " SELECT destination AS link_id, round(min(dist), 7) AS min_dist FROM z GROUP BY 1"),
    "AGG30_catchment_summary": (flagship, FLAG_SQL),
    "WGT1_stream_weights": (stream_weights, sql("CAST(count(*) AS DOUBLE) AS lumped", "round(sum(w), 7) AS iFLS", "round(sum(w * (accum + 1)) FILTER (cat <> 'R'), 7) AS HAiFLS")),
    "WGT3_outlet_weights": (outlet_weights, CATCH + ", m AS (SELECT *, dist - min(dist) OVER (PARTITION BY destination) AS o FROM z) SELECT destination AS link_id, round(sum(1 / (0.001::DOUBLE * o + 1)), 3) AS iFLO, round(sum(accum / (0.001::DOUBLE * o + 1)), 3) AS HAiFLO FROM m GROUP BY 1"),
}
