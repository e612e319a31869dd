"""Queries of the projections, filters, scalar functions, joins, aggregates, windows, sorts and set operations.

Each is the shape in which the analytics use the operator, bound to the test tables.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from headwater.operators.relational import all_min, keep_extreme, nearest_within, numbered, replace_by_key, split_cached
from headwater.plans.views import LINKS, links, table


def t(name):
    return lambda s, d: table(s, d, name)


part, supplier, customer, orders, nation, region, lineitem, events = map(t, ("part", "supplier", "customer", "orders", "nation", "region", "lineitem", "events"))

#: Most links that flow into one.
MOST = 7

#: Layers of a whole dataset, by kind.
LAYERS = {
    "Raster": "dem_raw dem_final dem_d8 dem_accum_d8 dem_accum_d8_sca dem_streams_d8 iFLS HAiFLS iFLO_unn_groupab12 HAiFLO_unn_groupab12 landuse_1 slope Elevation",
    "Vector": "DEM_Extent stream_links stream_lines stream_points snapped_points original_points Subbasins_poly Catchment_poly",
    "Table": "site_id_col loi_meta unnest_catchment stream_links_attr stream_points_attr ds_flowpaths us_flowpaths fcon_pwise_dist funcon_pwise_dist weight_meta",
}
VALUES = ", ".join(f"('{n}', '{k}')" for k, names in LAYERS.items() for n in names.split())
#: Fixed groups of layer names.
GROUPS = {
    "meta": "site_id_col DEM_Extent loi_meta unnest_catchment",
    "sample_points": "snapped_points original_points",
    "hydro": "Elevation stream_links stream_lines stream_points Subbasins_poly Catchment_poly stream_points_attr stream_links_attr",
    "flow_path": "ds_flowpaths us_flowpaths",
    "pwise_dist": "funcon_pwise_dist fcon_pwise_dist",
}
BY_NAME = " ".join(f"WHEN layer_name IN ({', '.join(repr(n) for n in names.split())}) THEN '{g}'" for g, names in GROUPS.items())


def dataset(s, d):
    """A dataset in the shared folder with every layer of ``LAYERS``; its metadata names the site column."""
    from headwater.functions.steps import shared_folder
    from headwater.sources.dataset import Dataset

    out = Dataset.create(s, f"{shared_folder(s)}/{uuid.uuid4().hex}")
    out.register([(n, k) for k, names in LAYERS.items() for n in names.split()])
    out.write("site_id_col", s.createDataFrame([("site_id",)], "site_id_col string"))
    return out


def src2(s, d):
    return dataset(s, d).layers()


def prj6(s, d):
    some = nation(s, d)
    n = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    ranked = some.withColumn("nm", F.row_number().over(n))
    wide = ranked.groupBy("n_regionkey").pivot("nm", list(range(1, MOST + 1))).agg(F.first("n_nationkey").alias("link"), F.first("n_name").alias("trib"))
    return wide.select("n_regionkey", *[F.col(f"{k}_{c}").alias(f"us{c}_id{k}") for k in range(1, MOST + 1) for c in ("link", "trib")])


def prj10(s, d):
    listed = orders(s, d).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    return listed.select("o_custkey", F.inline(F.arrays_zip(F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.o_orderstatus").alias("o_orderstatus"))))


def jn4(s, d):
    some = links(s, d).where("ds_link_id IS NOT NULL").select("link_id", "ds_link_id")
    dim = part(s, d).select("p_partkey", "p_brand")
    own = dim.select(F.col("p_partkey").alias("link_id"), F.col("p_brand").alias("brand"))
    other = dim.select(F.col("p_partkey").alias("ds_link_id"), F.col("p_brand").alias("ds_brand"))
    return some.join(own, "link_id", "left").join(other, "ds_link_id", "left").select("link_id", "brand", "ds_link_id", "ds_brand")


def points(df, key, balance):
    return df.select(F.col(key).alias("id"), F.pmod(F.col(key) * 37, F.lit(1000)).cast("double").alias("x"), (F.round(F.abs(balance)) % 1000).alias("y"))


def jn11(s, d):
    sites = points(customer(s, d), "c_custkey", "c_acctbal")
    spots = points(supplier(s, d), "s_suppkey", "s_acctbal")
    return nearest_within(sites, spots, 60.0).select(F.col("id").alias("site_id"), F.col("near_id").alias("link_id"), F.round("distance", 4).alias("distance"))


def jn10(s, d):
    frames = [lineitem(s, d).where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.sum("l_quantity").alias(f"q_{f}")) for f in "ANR"]
    return reduce(lambda a, b: a.join(b, "l_partkey", "left"), [part(s, d).select(F.col("p_partkey").alias("l_partkey")), *frames])


def scl6(s, d):
    w = Window.partitionBy("c_nationkey")
    rn = F.row_number().over(w.orderBy("c_custkey")).alias("rn")
    some = customer(s, d).select("c_custkey", "c_nationkey", rn)
    return some.select("c_custkey", F.concat("c_nationkey", F.lit("."), F.lpad(F.col("rn").cast("string"), F.length(F.max("rn").over(w).cast("string")), "0")).alias("link_id"))


def scl7(s, d):
    known = F.array(*[F.lit(float(x)) for x in (905, 920, 935, 950, 965, 980, 995)])
    nearest = F.array_min(F.transform(known, lambda k: F.struct(F.abs(F.col("p_retailprice") - k).alias("gap"), k.alias("k"))))
    return part(s, d).select("p_partkey", nearest["k"].alias("nearest"))


def win3(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return orders(s, d).select("o_orderkey", F.last(v, ignorenulls=True).over(w).alias("filled"))


def win10(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    v = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return orders(s, d).select("o_orderkey", F.when((F.row_number().over(w) == 1) & v.isNull(), F.col("o_custkey")).otherwise(v).alias("id"))


def flt7(s, d):
    w = Window.partitionBy("l_partkey")
    some = lineitem(s, d).groupBy("l_partkey", "l_linenumber").agg(F.avg("l_quantity").alias("share"))
    start = F.coalesce(F.min(F.when(F.col("share") > 40, F.col("l_linenumber"))).over(w), F.lit(0))
    return some.withColumn("start", start).where("l_linenumber >= start").select("l_partkey", "l_linenumber", "start")


def agg5(s, d):
    return orders(s, d).groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("x")).select("o_custkey", "x.*")


def agg6(s, d):
    some = points(customer(s, d), "c_custkey", "c_acctbal").select((F.col("id") % 50).alias("g"), (F.col("x") % 7).alias("x"), (F.col("y") % 5).alias("y")).distinct()
    return some.groupBy("g").agg(F.round(F.avg("x"), 7).alias("x"), F.round(F.avg("y"), 7).alias("y"))


def set5(s, d):
    wanted = customer(s, d).select(F.col("c_custkey").alias("k"))
    cached, missing = split_cached(wanted, orders(s, d).select(F.col("o_custkey").alias("k")), "k")
    return cached.withColumn("state", F.lit("cached")).union(missing.withColumn("state", F.lit("missing")))


def set4(s, d):
    some = nation(s, d).select("n_nationkey", "n_name")
    new = some.where("n_nationkey % 3 = 0").select("n_nationkey", F.upper("n_name").alias("n_name"))
    return replace_by_key(some, new, ["n_nationkey"])


QUERIES = {
    "SRC2_catalog": (
        src2,
        f"SELECT layer_name, data_type, CASE WHEN starts_with(layer_name, 'dem_') THEN 'hydro' WHEN regexp_matches(layer_name, 'iFLS|HAiFLS|iFLO|HAiFLO') THEN 'iDW' {BY_NAME} ELSE 'loi' END AS data_group FROM (VALUES {VALUES}) v(layer_name, data_type)",
    ),
    "SRC4_table_scan": (lambda s, d: links(s, d), f"WITH {LINKS} SELECT * FROM links"),
    "SRC7_key_filtered_scan": (
        lambda s, d: lineitem(s, d).select("l_partkey", "l_quantity").join(part(s, d).where("p_size = 7").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi"),
        "SELECT l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)",
    ),
    "SRC9_metadata": (lambda s, d: dataset(s, d).table("site_id_col"), "SELECT 'site_id' AS site_id_col"),
    "PRJ1_select_rename": (lambda s, d: part(s, d).select("p_partkey", *[c for c in part(s, d).columns if c.startswith("p_b") or c == "absent"]).withColumnsRenamed({"p_brand": "brand"}), "SELECT p_partkey, p_brand AS brand FROM part"),
    "PRJ2_computed": (lambda s, d: part(s, d).select("p_partkey").withColumn("twice", F.col("p_partkey") * 2), "SELECT p_partkey, p_partkey * 2 AS twice FROM part"),
    "PRJ3_transmute": (lambda s, d: part(s, d).selectExpr("p_size + 1 AS next"), "SELECT p_size + 1 AS next FROM part"),
    "PRJ4_across": (lambda s, d: all_min(part(s, d).select("p_brand", "p_size", "p_retailprice"), ["p_brand"]), "SELECT p_brand, min(p_size) AS p_size, min(p_retailprice) AS p_retailprice FROM part GROUP BY 1"),
    "PRJ5_pivot_incidence": (lambda s, d: lineitem(s, d).groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.first(F.lit(1))).fillna(0), "SELECT l_suppkey, " + ", ".join(f"CAST(max(l_returnflag = '{v}') AS INTEGER) AS {v}" for v in "ANR") + " FROM lineitem GROUP BY 1"),
    "PRJ6_pivot_two_values": (prj6, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nm FROM nation) SELECT n_regionkey, " + ", ".join(f"max(n_nationkey) FILTER (nm = {k}) AS uslink_id{k}, max(n_name) FILTER (nm = {k}) AS ustrib_id{k}" for k in range(1, MOST + 1)) + " FROM r GROUP BY 1"),
    "PRJ7_pivot_longer": (lambda s, d: part(s, d).select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "name", "value"), "SELECT p_partkey, name, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR name IN (size, price))"),
    "PRJ9_nest_unnest": (lambda s, d: orders(s, d).groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k")).select("o_custkey", F.explode("k").alias("o_orderkey")), "SELECT o_custkey, o_orderkey FROM orders"),
    "PRJ10_pivot_lists": (prj10, "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders"),
    "PRJ11_horizontal_bind": (lambda s, d: part(s, d).select("p_partkey", "p_size").join(part(s, d).select("p_partkey", "p_brand"), "p_partkey"), "SELECT p_partkey, p_size, p_brand FROM part"),
    "FLT1_predicate": (lambda s, d: links(s, d).where("link_lngth > 25").select("link_id"), f"WITH {LINKS} SELECT link_id FROM links WHERE link_lngth > 25"),
    "FLT2_in_set": (lambda s, d: part(s, d).where(F.col("p_size").isin(1, 5, 9)).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)"),
    "FLT3_null_test": (lambda s, d: links(s, d).where(F.when(F.col("ds_link_id").isNull(), True).otherwise(F.col("site_id").isNotNull())).select("link_id"), f"WITH {LINKS} SELECT link_id FROM links WHERE CASE WHEN ds_link_id IS NULL THEN true ELSE site_id IS NOT NULL END"),
    "FLT4_dynamic_column": (lambda s, d: links(s, d).where(F.col("site_id").isNotNull()).select("link_id"), f"WITH {LINKS} SELECT link_id FROM links WHERE site_id IS NOT NULL"),
    "FLT5_group_extreme": (lambda s, d: keep_extreme(part(s, d).select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size"), "SELECT p_brand, p_partkey, p_size FROM part QUALIFY p_size = max(p_size) OVER (PARTITION BY p_brand)"),
    "FLT6_group_exists": (lambda s, d: orders(s, d).withColumn("any", F.bool_or(F.col("o_totalprice") > 300000).over(Window.partitionBy("o_custkey"))).where("any").select("o_orderkey"), "SELECT o_orderkey FROM orders QUALIFY bool_or(o_totalprice > 300000) OVER (PARTITION BY o_custkey)"),
    "FLT7_first_passing": (flt7, "WITH a AS (SELECT l_partkey, l_linenumber, avg(l_quantity) AS share FROM lineitem GROUP BY 1, 2), b AS (SELECT *, coalesce(min(l_linenumber) FILTER (share > 40) OVER (PARTITION BY l_partkey), 0) AS start FROM a) SELECT l_partkey, l_linenumber, start FROM b WHERE l_linenumber >= start"),
    "SCL1_case": (lambda s, d: part(s, d).select("p_partkey", F.when(F.col("p_size") > 30, "large").when(F.col("p_size") > 10, "middle").otherwise("small").alias("class")), "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS class FROM part"),
    "SCL2_na_if": (lambda s, d: lineitem(s, d).select("l_orderkey", F.nullif("l_discount", F.lit(0.0)).alias("v")), "SELECT l_orderkey, nullif(l_discount, 0) AS v FROM lineitem"),
    "SCL3_casts": (lambda s, d: part(s, d).select(F.col("p_partkey").cast("string").alias("k"), F.col("p_brand").try_cast("int").alias("n")), "SELECT CAST(p_partkey AS VARCHAR) AS k, TRY_CAST(p_brand AS INTEGER) AS n FROM part"),
    "SCL4_math": (lambda s, d: part(s, d).select("p_partkey", F.round(F.ln("p_retailprice"), 6).alias("l"), F.round(F.sqrt("p_retailprice"), 6).alias("q"), F.floor("p_retailprice").alias("f"), F.ceil("p_retailprice").alias("c"), F.abs(-F.col("p_size")).alias("a")), "SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(sqrt(p_retailprice), 6) AS q, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(-p_size) AS a FROM part"),
    "SCL5_strings": (lambda s, d: part(s, d).select("p_partkey", F.regexp_replace("p_brand", "[0-9]+", "#").alias("r"), F.col("p_brand").rlike("[13]$").alias("m"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("z"), F.concat_ws("_", "p_brand", "p_size").alias("p"), F.substring("p_type", 1, 3).alias("s")), "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#') AS r, regexp_matches(p_brand, '[13]$') AS m, lpad(CAST(p_size AS VARCHAR), 4, '0') AS z, p_brand || '_' || p_size AS p, substring(p_type, 1, 3) AS s FROM part"),
    "SCL6_decimal_ids": (scl6, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer), m AS (SELECT *, max(rn) OVER (PARTITION BY c_nationkey) AS top FROM r) SELECT c_custkey, c_nationkey || '.' || lpad(CAST(rn AS VARCHAR), CAST(length(CAST(top AS VARCHAR)) AS INTEGER), '0') AS link_id FROM m"),
    "SCL7_nearest_value": (scl7, "SELECT p_partkey, min_by(k, abs(p_retailprice - k)) AS nearest FROM part, (SELECT CAST(unnest([905, 920, 935, 950, 965, 980, 995]) AS DOUBLE) AS k) GROUP BY 1"),
    "SCL8_inverse_distance": (lambda s, d: part(s, d).select("p_partkey", F.round(1.0 / (0.001 * F.col("p_retailprice") + 1.0), 8).alias("w")), "SELECT p_partkey, round(1 / (0.001::DOUBLE * p_retailprice + 1), 8) AS w FROM part"),
    "SCL10_arrays": (lambda s, d: orders(s, d).groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k")).select("o_custkey", F.element_at("k", 1).alias("head"), F.element_at("k", -1).alias("tail"), F.size(F.slice("k", 2, 1000)).cast("long").alias("rest")), "SELECT o_custkey, min(o_orderkey) AS head, max(o_orderkey) AS tail, count(*) - 1 AS rest FROM orders GROUP BY 1"),
    "JN1_left": (lambda s, d: customer(s, d).select("c_custkey", "c_nationkey").join(nation(s, d).where("n_nationkey > 10").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left"), "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey > 10"),
    "JN2_composite": (lambda s, d: lineitem(s, d).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q")).join(lineitem(s, d).where("l_tax > 0.05").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")), ["l_orderkey", "l_linenumber"], "left"), "SELECT a.*, n FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) a LEFT JOIN (SELECT l_orderkey AS o, l_linenumber AS l, count(*) AS n FROM lineitem WHERE l_tax > 0.05 GROUP BY 1, 2) ON l_orderkey = o AND l_linenumber = l"),
    "JN4_two_lookups": (jn4, f"WITH {LINKS} SELECT link_id, a.p_brand AS brand, ds_link_id, b.p_brand AS ds_brand FROM links LEFT JOIN part a ON link_id = a.p_partkey LEFT JOIN part b ON ds_link_id = b.p_partkey WHERE ds_link_id IS NOT NULL"),
    "JN5_full": (lambda s, d: customer(s, d).select((F.col("c_custkey") * 2).alias("k"), "c_acctbal").join(supplier(s, d).select((F.col("s_suppkey") * 3).alias("k"), "s_acctbal"), "k", "full"), "SELECT coalesce(c_custkey * 2, s_suppkey * 3) AS k, c_acctbal, s_acctbal FROM customer FULL JOIN supplier ON c_custkey * 2 = s_suppkey * 3"),
    "JN7_right": (lambda s, d: supplier(s, d).select(F.col("s_nationkey").alias("k"), "s_suppkey").join(nation(s, d).select(F.col("n_nationkey").alias("k"), "n_name"), "k", "right"), "SELECT n_nationkey AS k, s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "JN8_anti": (lambda s, d: customer(s, d).select("c_custkey").join(orders(s, d).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "JN9_semi": (lambda s, d: customer(s, d).select("c_custkey").join(orders(s, d).where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "JN10_reduce": (jn10, "SELECT p_partkey AS l_partkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS \"q_A\", sum(l_quantity) FILTER (l_returnflag = 'N') AS \"q_N\", sum(l_quantity) FILTER (l_returnflag = 'R') AS \"q_R\" FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1"),
    "JN11_nearest_within": (jn11, "WITH s AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, round(abs(c_acctbal)) % 1000 AS y FROM customer), p AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS x, round(abs(s_acctbal)) % 1000 AS y FROM supplier), n AS (SELECT s.id, p.id AS near_id, sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) AS g FROM s JOIN p ON (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 3600), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, near_id) = 1) SELECT s.id AS site_id, near_id AS link_id, round(g, 4) AS distance FROM s LEFT JOIN b ON s.id = b.id"),
    "AGG1_grouped_sum": (lambda s, d: lineitem(s, d).groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")), "SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "AGG2_min_all": (lambda s, d: all_min(lineitem(s, d).select("l_partkey", "l_suppkey", "l_quantity", "l_tax"), ["l_partkey", "l_suppkey"]), "SELECT l_partkey, l_suppkey, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2"),
    "AGG3_distinct": (lambda s, d: lineitem(s, d).select("l_returnflag", "l_linestatus").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "AGG4_count_over": (lambda s, d: part(s, d).select("p_partkey", F.count("*").over(Window.partitionBy("p_brand")).alias("n")), "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS n FROM part"),
    "AGG5_first_of_group": (agg5, "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"),
    "AGG6_centroid": (agg6, "SELECT g, round(avg(x), 7) AS x, round(avg(y), 7) AS y FROM (SELECT DISTINCT c_custkey % 50 AS g, CAST((c_custkey * 37) % 1000 AS DOUBLE) % 7 AS x, (round(abs(c_acctbal)) % 1000) % 5 AS y FROM customer) GROUP BY 1"),
    "AGG27_global_max": (lambda s, d: part(s, d).agg(F.max("p_size").alias("m")), "SELECT max(p_size) AS m FROM part"),
    "AGG28_group_mean": (lambda s, d: supplier(s, d).groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 7).alias("m")), "SELECT s_nationkey, round(avg(s_acctbal), 7) AS m FROM supplier GROUP BY 1"),
    "AGG29_area": (lambda s, d: lineitem(s, d).groupBy("l_partkey").agg((F.count("*") * 900).alias("area")), "SELECT l_partkey, count(*) * 900 AS area FROM lineitem GROUP BY 1"),
    "AGG31_duplicates": (lambda s, d: lineitem(s, d).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "AGG32_categories": (lambda s, d: part(s, d).select("p_brand").distinct(), "SELECT DISTINCT p_brand FROM part"),
    "WIN1_running_sum": (lambda s, d: orders(s, d).select("o_orderkey", F.sum("o_custkey").over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)).alias("v")), "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM orders"),
    "WIN2_row_number": (lambda s, d: orders(s, d).select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey").desc())).alias("n")), "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS n FROM orders"),
    "WIN3_fill_down": (win3, "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS filled FROM orders"),
    "WIN4_group_extremes": (lambda s, d: part(s, d).select("p_partkey", F.max("p_size").over(Window.partitionBy("p_brand")).alias("hi"), F.min("p_size").over(Window.partitionBy("p_brand")).alias("lo")), "SELECT p_partkey, max(p_size) OVER (PARTITION BY p_brand) AS hi, min(p_size) OVER (PARTITION BY p_brand) AS lo FROM part"),
    "WIN6_group_tests": (lambda s, d: orders(s, d).select("o_orderkey", F.bool_or(F.col("o_orderstatus") == "F").over(Window.partitionBy("o_custkey")).alias("some"), F.bool_and(F.col("o_orderstatus") == "F").over(Window.partitionBy("o_custkey")).alias("every")), "SELECT o_orderkey, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS some, bool_and(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS every FROM orders"),
    "WIN7_last_of_group": (lambda s, d: orders(s, d).groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last")), "SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1"),
    "WIN8_group_index": (lambda s, d: part(s, d).select("p_partkey", "p_brand").join(numbered(part(s, d).select("p_brand").distinct(), [F.col("p_brand")], "g"), "p_brand").select("p_partkey", F.col("g").cast("int").alias("g")), "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) AS INTEGER) AS g FROM part"),
    "WIN9_two_of_group": (lambda s, d: orders(s, d).withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("n <= 2").select("o_orderkey"), "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2"),
    "WIN10_first_row_override": (win10, "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AND o_orderstatus <> 'F' THEN o_custkey WHEN o_orderstatus = 'F' THEN o_orderkey END AS id FROM orders"),
    "SRT1_sort": (lambda s, d: part(s, d).select("p_brand", "p_partkey").orderBy(F.col("p_brand").desc(), F.asc_nulls_last("p_partkey")), "SELECT p_brand, p_partkey FROM part ORDER BY p_brand DESC, p_partkey"),
    "SRT2_head": (lambda s, d: part(s, d).select("p_partkey").orderBy("p_partkey").limit(1), "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 1"),
    "SRT3_arg_min": (lambda s, d: part(s, d).groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("k")), "SELECT p_brand, p_partkey AS k FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1"),
    "SET1_union_by_name": (lambda s, d: part(s, d).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("a")).unionByName(supplier(s, d).select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b")), allowMissingColumns=True), "SELECT p_partkey AS k, p_size AS a, NULL::INTEGER AS b FROM part UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier"),
    "SET2_union_distinct": (lambda s, d: part(s, d).select(F.col("p_size").alias("k")).unionByName(supplier(s, d).select(F.col("s_nationkey").alias("k"))).distinct(), "SELECT p_size AS k FROM part UNION SELECT s_nationkey FROM supplier"),
    "SET3_except": (lambda s, d: part(s, d).select(F.col("p_size").alias("k")).subtract(supplier(s, d).select(F.col("s_nationkey").alias("k"))), "SELECT p_size AS k FROM part EXCEPT SELECT s_nationkey FROM supplier"),
    "SET3_intersect": (lambda s, d: part(s, d).select(F.col("p_size").alias("k")).intersect(supplier(s, d).select(F.col("s_nationkey").alias("k"))), "SELECT p_size AS k FROM part INTERSECT SELECT s_nationkey FROM supplier"),
    "SET4_replace_by_key": (set4, "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) ELSE n_name END AS n_name FROM nation"),
    "SET5_cached_missing": (set5, "SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'cached' ELSE 'missing' END AS state FROM customer"),
    "PRJ8_gather": (lambda s, d: part(s, d).select("p_partkey", F.explode(F.array(*[(F.col("p_partkey") + k).alias(f"n{k}") for k in (-1, 1, 64, -64)])).alias("near")), "SELECT p_partkey, unnest([p_partkey - 1, p_partkey + 1, p_partkey + 64, p_partkey - 64]) AS near FROM part"),
    "JN3_differently_named": (lambda s, d: supplier(s, d).join(nation(s, d), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name"), "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"),
    "JN17_positions": (lambda s, d: part(s, d).select("p_partkey", "p_brand").join(numbered(part(s, d).select("p_brand").distinct(), [F.col("p_brand")], "place"), "p_brand").select("p_partkey", F.col("place").cast("int").alias("place")), "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) AS INTEGER) AS place FROM part"),
    "WIN5_sequence": (lambda s, d: part(s, d).select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")).alias("n")), "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INTEGER) AS n FROM part"),
    "RAS40_categories_long": (lambda s, d: lineitem(s, d).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")), "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "ANA6_design_matrix": (lambda s, d: part(s, d).select("p_partkey", "p_size").join(lineitem(s, d).groupBy("l_partkey").pivot("l_returnflag", ["A", "R"]).agg(F.sum("l_quantity")).withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left").fillna(0, ["A", "R"]).select("p_partkey", "p_size", F.col("A").alias("rf_a"), F.col("R").alias("rf_r")), "SELECT p_partkey, p_size, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS rf_a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS rf_r FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2"),
}
