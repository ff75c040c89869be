"""Every operator as a query over the tables of a data directory, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.functions import dates, geo, parse, spectral, text
from gaugeflow.operators import entity, features, lookup, profile, quality, reshape, temporal
from gaugeflow.plans import pipelines
from gaugeflow.plans.bindings import observations, table
from gaugeflow.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, iso: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Add a query and its SQL; the columns ``iso`` are dates, given as ISO text by both."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in iso})
        if sql is not None:
            changed = ", ".join(f"{c}::VARCHAR AS {c}" for c in iso)
            text = f"SELECT * REPLACE ({changed}) FROM ({sql})" if iso else sql
            SQL[query.__name__] = text.replace("$OBS", OBS).replace("$CHECKED", CHECKED).replace("$FLAGGED", FLAGGED)
        return query

    return add


OBS = """(SELECT 'Station ' || user_id AS station_name, ts::DATE AS date,
  CASE event_type WHEN 'signup' THEN 'bod' WHEN 'view' THEN 'cod' WHEN 'click' THEN 'tds'
       WHEN 'error' THEN 'conductivity' WHEN 'purchase' THEN 'ph' ELSE event_type END AS parameter, value,
  CASE event_id % 3 WHEN 0 THEN 'cpcb' WHEN 1 THEN 'data_gov_in' ELSE 'other' END AS source, event_id AS _seq FROM events)"""
CHECKED = """(SELECT o.*, 'valid' AS quality_flag,
  round(CASE source WHEN 'cpcb' THEN 1.0::DOUBLE WHEN 'data_gov_in' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END
        * CASE WHEN abs(value - (lo + hi) / 2) / ((hi - lo) / 2) > 0.9::DOUBLE THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 3) AS trust_score
  FROM """ + OBS + """ o JOIN (VALUES ('bod', 0.0::DOUBLE, 1000.0::DOUBLE), ('cod', 0.0, 5000.0), ('tds', 0.0, 50000.0),
       ('conductivity', 0.0, 50000.0), ('ph', 0.0, 14.0)) b(parameter, lo, hi) USING (parameter)
  WHERE value BETWEEN lo AND hi)"""
_RANKED = """SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY value) AS rn, count(*) OVER (PARTITION BY parameter) AS n FROM """
FLAGGED = """(SELECT station_name, date, parameter, value, source, _seq,
  CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN 'suspect_outlier' ELSE quality_flag END AS quality_flag,
  CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN trust_score * 0.5::DOUBLE ELSE trust_score END AS trust_score
  FROM """ + CHECKED + """ c LEFT JOIN (
    SELECT parameter, max(CASE WHEN rn = n // 4 + 1 THEN value END) AS q1, max(CASE WHEN rn = 3 * n // 4 + 1 THEN value END) AS q3
    FROM (""" + _RANKED + CHECKED + """) GROUP BY parameter HAVING max(n) >= 20 AND q1 <> q3) USING (parameter))"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.range_check(observations(spark, sf_dir))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_outliers(checked(spark, sf_dir))


# --- quality control ----------------------------------------------------------


@register("SELECT station_name, date, parameter, value, source, _seq, quality_flag, trust_score FROM $CHECKED", iso=("date",))
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("station_name", "date", "parameter", "value", "source", "_seq", "quality_flag", "trust_score")


@register("SELECT _seq, parameter, value, quality_flag, trust_score FROM $FLAGGED")
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("_seq", "parameter", "value", "quality_flag", "trust_score")


_CONSISTENT = """WITH f AS (SELECT * FROM $FLAGGED),
last AS (SELECT station_name, date, arg_max(value, _seq) FILTER (parameter = 'bod') AS bod, arg_max(value, _seq) FILTER (parameter = 'cod') AS cod,
  arg_max(value, _seq) FILTER (parameter = 'tds') AS tds, arg_max(value, _seq) FILTER (parameter = 'conductivity') AS ec FROM f GROUP BY ALL),
bad AS (SELECT station_name, date, coalesce(bod > cod * 2.0::DOUBLE, false) OR coalesce(ec > 0 AND (tds / ec < 0.2::DOUBLE OR tds / ec > 1.5::DOUBLE), false) AS bad FROM last)
"""


@register(
    _CONSISTENT
    + """SELECT _seq, CASE WHEN bad AND quality_flag = 'valid' THEN 'suspect_consistency' ELSE quality_flag END AS quality_flag,
round(CASE WHEN bad AND quality_flag = 'valid' THEN trust_score * 0.7::DOUBLE ELSE trust_score END, 9) AS trust_score
FROM f JOIN bad USING (station_name, date)"""
)
def consistency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.flag_inconsistent(flagged(spark, sf_dir))
    return df.select("_seq", "quality_flag", F.round("trust_score", 9).alias("trust_score"))


_FUSED = """SELECT station_name, date, parameter, arg_max(value, (trust_score, -_seq)) AS value,
  CASE WHEN count(*) > 1 AND max(value) > 0 AND (max(value) - min(value)) / greatest(max(value), 0.001::DOUBLE) < 0.1::DOUBLE
       THEN 'valid' ELSE arg_max(quality_flag, (trust_score, -_seq)) END AS quality_flag,
  CASE WHEN count(*) > 1 AND max(value) > 0 AND (max(value) - min(value)) / greatest(max(value), 0.001::DOUBLE) < 0.1::DOUBLE
       THEN least(1.0::DOUBLE, max(trust_score) * 1.2::DOUBLE) ELSE max(trust_score) END AS trust_score,
  CASE WHEN count(*) > 1 THEN list_aggregate(list_sort(list_distinct(list(source))), 'string_agg', '; ') END AS all_sources,
  arg_max(source, (trust_score, -_seq)) AS source, arg_max(_seq, (trust_score, -_seq)) AS _seq
FROM $FLAGGED GROUP BY station_name, date, parameter"""


@register(f"SELECT station_name, date, parameter, value, quality_flag, round(trust_score, 9) AS trust_score, all_sources FROM ({_FUSED})", iso=("date",))
def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.fuse(flagged(spark, sf_dir))
    return df.select("station_name", "date", "parameter", "value", "quality_flag", F.round("trust_score", 9).alias("trust_score"), "all_sources")


@register(
    f"""SELECT station_name, date, count(*) AS n_params, round(least(1.0::DOUBLE, min(trust_score)), 9) AS min_trust, round(avg(trust_score) + 1e-12::DOUBLE, 3) AS mean_trust,
max(value) FILTER (parameter = 'bod') AS bod, max(value) FILTER (parameter = 'cod') AS cod, max(value) FILTER (parameter = 'tds') AS tds,
max(value) FILTER (parameter = 'conductivity') AS conductivity, max(value) FILTER (parameter = 'ph') AS ph
FROM ({_FUSED}) GROUP BY station_name, date""", iso=("date",))
def outliers_fusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.fuse(flagged(spark, sf_dir))
    for c, kind in (("station_code", "string"), ("state", "string"), ("year", "int"), ("latitude", "double"), ("longitude", "double")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    wide = reshape.pivot_wide(df, ["bod", "cod", "tds", "conductivity", "ph"])
    return wide.select("station_name", "date", "n_params", F.round("min_trust", 9).alias("min_trust"), "mean_trust", "bod", "cod", "tds", "conductivity", "ph")


_CANON = """(SELECT parameter, value - 1.0::DOUBLE AS value, _seq, date AS sample_date, station_name AS station_id, source, 'valid' AS quality_flag, 1.0::DOUBLE AS confidence FROM $OBS)"""
_VALIDATED = f"""(SELECT c._seq, c.parameter, c.value, c.station_id, c.sample_date, c.source,
  CASE WHEN value < h0 OR value > h1 OR value < 0 THEN 'rejected' WHEN value < s0 OR value > s1 THEN 'suspect_range' ELSE 'valid' END AS quality_flag,
  CASE WHEN value < h0 OR value > h1 THEN 1.0 WHEN value < s0 OR value > s1 THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence
  FROM {_CANON} c JOIN (VALUES ('bod', 0.0, 0.0, 100.0, 1000.0), ('cod', 0.0, 0.0, 500.0, 5000.0), ('tds', 0.0, 10.0, 3000.0, 50000.0),
    ('conductivity', 0.0, 10.0, 5000.0, 50000.0), ('ph', 0.0, 4.0, 10.0, 14.0)) b(parameter, h0, s0, s1, h1) USING (parameter))"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return obs.select(
        "parameter", (F.col("value") - 1.0).alias("value"), "_seq", F.col("date").alias("sample_date"), F.col("station_name").alias("station_id"), "source",
        F.lit("valid").alias("quality_flag"), F.lit(1.0).alias("confidence"), F.lit("").alias("notes"),
    )


@register(f"SELECT _seq, parameter, value, quality_flag, confidence FROM {_VALIDATED}")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate(_canonical(spark, sf_dir)).select("_seq", "parameter", "value", "quality_flag", "confidence")


@register(
    f"""WITH v AS (SELECT * FROM {_VALIDATED}), r AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY value) AS rn, count(*) OVER (PARTITION BY parameter) AS n FROM v WHERE quality_flag <> 'rejected'),
q AS (SELECT parameter, max(CASE WHEN rn = n // 4 + 1 THEN value END) AS q1, max(CASE WHEN rn = 3 * n // 4 + 1 THEN value END) AS q3 FROM r GROUP BY parameter HAVING max(n) >= 20 AND q1 <> q3)
SELECT _seq, CASE WHEN quality_flag = 'valid' AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) THEN 'suspect_outlier' ELSE quality_flag END AS quality_flag,
CASE WHEN quality_flag = 'valid' AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) THEN confidence * 0.5 ELSE confidence END AS confidence FROM v LEFT JOIN q USING (parameter)"""
)
def validation_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_outliers(quality.validate(_canonical(spark, sf_dir))).select("_seq", "quality_flag", "confidence")


@register(
    f"""WITH v AS (SELECT * FROM {_VALIDATED}), last AS (SELECT station_id, sample_date, arg_max(value, _seq) FILTER (parameter = 'bod') AS bod, arg_max(value, _seq) FILTER (parameter = 'cod') AS cod,
 arg_max(value, _seq) FILTER (parameter = 'tds') AS tds, arg_max(value, _seq) FILTER (parameter = 'conductivity') AS ec FROM v WHERE quality_flag <> 'rejected' GROUP BY ALL),
bad AS (SELECT station_id, sample_date, coalesce(bod > cod * 1.2::DOUBLE, false) OR coalesce(ec IS NOT NULL AND (tds / greatest(ec, 0.01::DOUBLE) < 0.2::DOUBLE OR tds / greatest(ec, 0.01::DOUBLE) > 1.5::DOUBLE), false) AS bad FROM last)
SELECT _seq, CASE WHEN bad AND quality_flag = 'valid' THEN 'suspect_consistency' ELSE quality_flag END AS quality_flag,
CASE WHEN bad AND quality_flag = 'valid' THEN confidence * 0.7::DOUBLE ELSE confidence END AS confidence FROM v LEFT JOIN bad USING (station_id, sample_date)"""
)
def validation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_consistency(quality.validate(_canonical(spark, sf_dir))).select("_seq", "quality_flag", "confidence")


@register(
    """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part, date_trunc('month', l_shipdate)::DATE AS month, l_quantity AS value,
  CASE WHEN l_linestatus = 'O' THEN 'cpcb' ELSE 'cwc' END AS source, l_orderkey * 10 + l_linenumber AS _seq FROM lineitem),
g AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, min(value) OVER w AS lo, max(value) OVER w AS hi, min(_seq) OVER w AS f,
  first_value(_seq) OVER (PARTITION BY part, month ORDER BY CASE source WHEN 'cpcb' THEN 1.0 ELSE 0.95 END DESC, _seq) AS best FROM r WINDOW w AS (PARTITION BY part, month)),
s AS (SELECT part, month, count(DISTINCT source) AS s FROM r GROUP BY ALL),
o AS (SELECT g.*, CASE WHEN n = 1 THEN 'single' WHEN s = 1 THEN 'averaged' WHEN mean = 0 THEN 'kept'
  WHEN greatest(hi - mean, mean - lo) / abs(mean) <= 0.2::DOUBLE THEN 'agreed' ELSE 'conflict' END AS outcome FROM g JOIN s USING (part, month))
SELECT id, outcome, CASE WHEN outcome = 'averaged' THEN round(mean, 4) ELSE value END AS value,
CASE WHEN outcome = 'agreed' AND _seq <> best THEN 'suspect_duplicate' WHEN outcome = 'conflict' AND _seq <> best THEN 'suspect_consistency' ELSE 'valid' END AS quality_flag,
CASE WHEN outcome <> 'conflict' THEN 1.0 WHEN _seq = best THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence
FROM o WHERE outcome <> 'averaged' OR _seq = f"""
)
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"),
        F.col("l_quantity").alias("value"), F.when(F.col("l_linestatus") == "O", "cpcb").otherwise("cwc").alias("source"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_seq"), F.lit("valid").alias("quality_flag"), F.lit(1.0).alias("confidence"),
    )
    return quality.resolve_conflicts(rows, ["part", "month"]).select("id", "outcome", "value", "quality_flag", "confidence")


@register(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS BOD_mg_l FROM lineitem
WHERE NOT coalesce(CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END > 2 * CASE WHEN l_discount * 200 BETWEEN 5 AND 18 THEN l_discount * 200 END, false)
UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM lineitem
WHERE coalesce(CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END > 2 * CASE WHEN l_discount * 200 BETWEEN 5 AND 18 THEN l_discount * 200 END, false)"""
)
def wide_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("BOD_mg_l"), (F.col("l_discount") * 200).alias("COD_mg_l"))
    clipped = quality.clip_bounds(li, {"BOD_mg_l": (5.0, 45.0), "COD_mg_l": (5.0, 18.0)})
    return quality.null_excess(clipped).drop("COD_mg_l")


# --- joins ----------------------------------------------------------------------


@register("""SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def station_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id"), "c_name", "c_nationkey", F.col("c_custkey").alias("_seq"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("station_id"))
    return lookup.station_lookup(orders, stations).select("o_orderkey", "c_name", "c_nationkey")


@register("SELECT DISTINCT c_custkey::VARCHAR AS station_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def station_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id"))
    return lookup.lookup_misses(left, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station_id")))


def _readings_scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    readings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date")).distinct()
    scenes = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.to_date("l_shipdate").alias("scene_date"), (F.col("l_discount") * 1000).alias("cloud"), F.col("l_quantity").alias("B1"), F.col("l_extendedprice").alias("B2"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene_id"),
    )
    return readings, scenes


_SCENES = """r AS (SELECT DISTINCT o_custkey AS key, o_orderdate::DATE AS date FROM orders),
s AS (SELECT l_partkey AS key, l_shipdate::DATE AS scene_date, l_discount * 1000 AS cloud, l_quantity AS B1, l_extendedprice AS B2, l_orderkey * 10 + l_linenumber AS scene_id FROM lineitem)"""


@register(
    f"""WITH {_SCENES}, c AS (SELECT r.key, r.date, s.B1, s.B2, CASE WHEN abs(scene_date - date) <= 3 AND cloud < 20 THEN 0 WHEN abs(scene_date - date) <= 10 AND cloud < 60 THEN 1
  WHEN abs(scene_date - date) <= 30 AND cloud < 100 THEN 2 END AS tier FROM r JOIN s ON r.key = s.key AND abs(scene_date - date) <= 30),
m AS (SELECT *, min(tier) OVER (PARTITION BY key, date) AS best FROM c WHERE tier IS NOT NULL)
SELECT key, date, tier, count(*) AS scene_count, median(B1) AS B1, median(B2) AS B2 FROM m WHERE tier = best GROUP BY key, date, tier""", iso=("date",))
def tiered_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.tiered_composite(*_readings_scenes(spark, sf_dir), ["key"], ["B1", "B2"])


@register(
    f"""WITH {_SCENES} SELECT key, date, scene_date, cloud, scene_id FROM (SELECT r.key, r.date, scene_date, cloud, scene_id,
row_number() OVER (PARTITION BY r.key, r.date ORDER BY cloud, scene_id, scene_date) AS rn FROM r JOIN s ON r.key = s.key AND abs(scene_date - date) <= 3 AND cloud < 60) WHERE rn = 1""", iso=("date", "scene_date",))
def nearest_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, scenes = _readings_scenes(spark, sf_dir)
    scenes = scenes.withColumn("_tie", F.struct("scene_id", "scene_date"))
    return temporal.nearest_clear(readings, scenes, ["key"], tie="_tie").select("key", "date", "scene_date", "cloud", "scene_id")


_STATIONS = """st AS (SELECT p_partkey AS id, p_name AS name, 25.0::DOUBLE + p_size * 0.002::DOUBLE + (p_partkey % 200) * 0.1::DOUBLE AS lat, 80.0::DOUBLE + (p_partkey % 7) * 0.004::DOUBLE AS lon FROM part),
l AS (SELECT * FROM st WHERE id % 2 = 0), r AS (SELECT * FROM st WHERE id % 2 = 1),
p AS (SELECT l.id AS left_id, r.id AS right_id, string_split(l.name, ' ') AS a, string_split(r.name, ' ') AS b,
 pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2) AS h FROM l, r),
d AS (SELECT *, 2 * 6371.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS km FROM p),
e AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS sim, CASE WHEN km <= 0.1 THEN 1.0 WHEN km >= 4 THEN 0.0 ELSE 1 - km / 4 END AS near FROM d)"""


@register(f"WITH {_STATIONS} SELECT left_id, right_id, round(km, 6) AS km, round(sim * 0.4 + near * 0.6, 6) AS score FROM e WHERE sim * 0.4::DOUBLE + near * 0.6::DOUBLE >= 0.7::DOUBLE")
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (25.0 + F.col("p_size") * 0.002 + (F.col("p_partkey") % 200) * 0.1).alias("lat"), (80.0 + (F.col("p_partkey") % 7) * 0.004).alias("lon"),
    )
    found = entity.fuzzy_join(stations.where("id % 2 = 0"), stations.where("id % 2 = 1"))
    return found.select("left_id", "right_id", F.round("km", 6).alias("km"), F.round("score", 6).alias("score"))


@register()
def station_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        F.lit("cpcb").alias("source"), F.col("s_suppkey").cast("string").alias("source_station_id"), F.concat(F.lit("Ganga at "), (F.col("s_nationkey") % 5).cast("string")).alias("station_name"),
        F.lit("Ganga").alias("river"), F.lit("Bihar").alias("state"), (25.0 + F.col("s_nationkey") * 0.01).alias("latitude"), F.lit(85.0).alias("longitude"), F.col("s_suppkey").alias("_seq"),
    )
    return entity.station_registry(s)


# --- reshapes, sets, order -------------------------------------------------------


@register(
    """SELECT l_orderkey, l_linenumber, parameter, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME parameter VALUE value)"""
)
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register(
    """SELECT user_id, ts::DATE AS day, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase,
arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY ALL""", iso=("day",))
def pivot_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return reshape.pivot_last(e, ["user_id", "day"], ["click", "view", "purchase"], "event_type", "value", "event_id")


@register("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.last_of_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@register(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 2) DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return reshape.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@register("SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) ORDER BY n DESC, p_brand LIMIT 15")
def top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.top(profile.counts_by(table(spark, sf_dir, "part"), "p_brand"), "n", 15, "p_brand")


@register()
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.exact_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", n=500)


@register("SELECT event_id, value, event_type FROM events WHERE value > 50 AND event_type <> 'error' OR event_type = 'signup' AND value < 1")
def adhoc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.query(table(spark, sf_dir, "events"), "value > 50 & event_type <> 'error' | event_type == 'signup' & value < 1", ["event_id", "value", "event_type"])


# --- profiles --------------------------------------------------------------------


@register("SELECT dimension, value, count(*) AS n FROM (SELECT unnest(['l_returnflag', 'l_linestatus']) AS dimension, unnest([l_returnflag, l_linestatus]) AS value FROM lineitem) GROUP BY ALL")
def multi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.multi_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2)::DOUBLE AS pct FROM events GROUP BY event_type")
def share_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.share_by(table(spark, sf_dir, "events"), "event_type")
    return out.withColumn("pct", F.col("pct").cast("double"))


@register("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag, count(DISTINCT l_suppkey) AS stations, count(*) AS records, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last,
round(avg(l_discount), 4) AS trust FROM lineitem GROUP BY ROLLUP (l_returnflag)""", iso=("first", "last",))
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary_with_total(
        table(spark, sf_dir, "lineitem"), "l_returnflag",
        {"stations": F.count_distinct("l_suppkey"), "records": F.count(F.lit(1)), "first": F.to_date(F.min("l_shipdate")), "last": F.to_date(F.max("l_shipdate")), "trust": F.round(F.avg("l_discount"), 4)},
    )


@register("""SELECT column_name AS "column", filled, round(100.0 * filled / n, 4)::DOUBLE AS pct FROM (SELECT unnest(['l_quantity', 'l_tax']) AS column_name, unnest([count(l_quantity), count(l_tax)]) AS filled, count(*) AS n FROM lineitem)""")
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.fill_rates(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])
    return out.withColumn("pct", F.col("pct").cast("double"))


@register("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_sources FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def multi_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.multi_source_keys(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")


@register(
    """SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min,
round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(max(l_extendedprice), 4) AS max FROM lineitem GROUP BY 1"""
)
def describe_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@register(
    """SELECT parameter, count(value) AS n, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max,
round(avg((value BETWEEN lo AND hi)::INT) * 100, 4) AS in_range_pct FROM $OBS JOIN (VALUES ('bod', 0.0, 1000.0), ('cod', 0.0, 5000.0), ('tds', 0.0, 50000.0), ('conductivity', 0.0, 50000.0), ('ph', 0.0, 14.0)) b(parameter, lo, hi) USING (parameter) GROUP BY parameter"""
)
def range_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.range_profile(observations(spark, sf_dir), lookup.record_bounds(spark))


@register(
    """WITH q AS (SELECT parameter, quantile_cont(value, 0.02) AS p2, quantile_cont(value, 0.25) AS p25, median(value) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.98) AS p98 FROM $OBS GROUP BY 1)
SELECT parameter, round(p2, 6) AS p2, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, round(p98, 6) AS p98, count(value) AS count, count(*) FILTER (value < p2) AS n_below_p2, count(*) FILTER (value > p98) AS n_above_p98,
count(*) FILTER (value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25)) AS n_iqr_outliers,
round(100.0 * count(*) FILTER (value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25)) / count(value), 4)::DOUBLE AS iqr_outlier_pct FROM $OBS JOIN q USING (parameter) GROUP BY ALL"""
)
def outlier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.outlier_profile(observations(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("p2", "p25", "median", "p75", "p98")}).withColumn("iqr_outlier_pct", F.col("iqr_outlier_pct").cast("double"))


@register(
    """SELECT target, count(*) AS total, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v <= -900) AS sentinel, count(*) FILTER (v > -900 AND v < lo) AS below_min, count(*) FILTER (v > hi) AS above_max,
count(*) FILTER (v BETWEEN lo AND hi) AS clean_count, round(100.0 * count(*) FILTER (v BETWEEN lo AND hi) / count(*), 4)::DOUBLE AS clean_pct
FROM (SELECT 'l_quantity' AS target, l_quantity AS v, 5 AS lo, 45 AS hi FROM lineitem UNION ALL SELECT 'l_discount', CASE WHEN l_discount = 0.05 THEN -999 ELSE l_discount END, 0.02, 0.08 FROM lineitem) GROUP BY target"""
)
def missing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") == 0.05, -999.0).otherwise(F.col("l_discount")))
    out = profile.missing_audit(li, {"l_quantity": (5.0, 45.0), "l_discount": (0.02, 0.08)})
    return out.withColumn("clean_pct", F.col("clean_pct").cast("double"))


@register("""SELECT o_orderstatus, count(*) FILTER (month(o_orderdate) = 1) AS "1", count(*) FILTER (month(o_orderdate) = 7) AS "7", count(*) FILTER (month(o_orderdate) = 12) AS "12" FROM orders GROUP BY 1""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("m", F.month("o_orderdate"))
    return profile.crosstab(o, "o_orderstatus", "m", [1, 7, 12])


@register(
    """WITH m AS (SELECT parameter, source, avg(value) AS m FROM $OBS GROUP BY ALL) SELECT a.parameter, a.source AS source_1, b.source AS source_2, round(a.m, 3) AS mean_1, round(b.m, 3) AS mean_2,
round(abs(a.m - b.m) / greatest(abs(a.m), 1e-6) * 100, 1) AS diff_pct FROM m a JOIN m b ON a.parameter = b.parameter AND a.source < b.source"""
)
def source_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.mean_differences(observations(spark, sf_dir))


@register("""SELECT parameter, l_returnflag, count(v) AS count, round(avg(v), 3) AS mean FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_tax']) AS parameter, unnest([l_quantity, l_tax]) AS v FROM lineitem) GROUP BY ALL""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.coverage(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"])


@register("""SELECT measure, count(*) AS n, count(*) FILTER (bad) AS violations, round(100.0 * count(*) FILTER (NOT bad) / count(*), 1)::DOUBLE AS compliance_pct FROM (
SELECT 'pH' AS measure, l_quantity < 6.5 OR l_quantity > 8.5 AS bad FROM lineitem UNION ALL SELECT 'BOD_mg_l', l_discount * 50 > 3.0 FROM lineitem) GROUP BY measure""")
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("pH"), (F.col("l_discount") * 50).alias("BOD_mg_l"))
    out = profile.compliance(li, schema.STANDARDS)
    return out.withColumn("compliance_pct", F.col("compliance_pct").cast("double"))


@register("SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt FROM lineitem GROUP BY 1")
def shape_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(profile.skewness("l_extendedprice"), 6).alias("skew"), F.round(profile.kurtosis("l_extendedprice"), 6).alias("kurt"))


@register("SELECT x, y, count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT 'l_quantity' AS x, unnest(['l_extendedprice', 'l_tax']) AS y, l_quantity AS a, unnest([l_extendedprice, l_tax]) AS b FROM lineitem) GROUP BY ALL")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_extendedprice", "l_tax"]).withColumn("r", F.round("r", 6))


@register("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rank_correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@register("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def monthly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(dates.month_period(F.col("ts")).alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@register("SELECT user_id, ts::DATE AS day, round(avg(value), 4) AS mean, min(event_id) AS first_id FROM events GROUP BY ALL", iso=("day",))
def daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("first_id", F.col("event_id"))
    out = profile.daily_means(rows, ["user_id"], "ts", ["value"], ["first_id"], "event_id")
    return out.withColumnsRenamed({"date": "day", "value": "mean"})


@register("SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1")
def mode_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.modes(table(spark, sf_dir, "events"), ["user_id"], ["event_type"]).withColumnRenamed("event_type", "mode")


@register("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "events"), "value", 30)


@register("""WITH e AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)
SELECT event_type, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM events JOIN e USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY 1""")
def box_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.box_numbers(table(spark, sf_dir, "events"), ["event_type"], "value")


@register("SELECT user_id, count(*) AS raw, count(*) FILTER (value < 50) AS cleaned, round(100.0 * count(*) FILTER (value < 50) / count(*), 2)::DOUBLE AS pct FROM events GROUP BY 1")
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return profile.survival(e, e.where("value < 50"), "user_id").withColumn("pct", F.col("pct").cast("double"))


@register("""WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS f FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - f) ** 2)), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae FROM p GROUP BY 1""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("f", F.col("l_quantity") * 1500)
    return features.regression_metrics(li, ["l_returnflag"], "l_extendedprice", "f").select("l_returnflag", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@register("SELECT channel, round(avg(v::DOUBLE), 6) AS mean, round(stddev_pop(v::DOUBLE), 6) AS std FROM (SELECT unnest(range(len(embedding)))::INT AS channel, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.channel_stats(table(spark, sf_dir, "embeddings"), "embedding")
    return out.select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("""WITH q AS (SELECT quantile_cont(l_quantity, [0.02, 0.05, 0.95, 0.98]) AS a, quantile_cont(l_tax, [0.02, 0.05, 0.95, 0.98]) AS b FROM lineitem),
k AS (SELECT l_returnflag, (l_quantity BETWEEN a[1] AND a[4])::INT + (l_tax BETWEEN b[1] AND b[4])::INT AS w, (l_quantity BETWEEN a[2] AND a[3])::INT + (l_tax BETWEEN b[2] AND b[3])::INT AS t FROM lineitem, q)
SELECT 'wide' AS level, l_returnflag, count(*) AS n, round(100.0 * avg((w >= 2)::INT), 4) AS kept_pct FROM k GROUP BY 2 UNION ALL SELECT 'tight', l_returnflag, count(*), round(100.0 * avg((t >= 2)::INT), 4) FROM k GROUP BY 2""")
def trimming_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.trimming_simulation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], {"wide": (0.02, 0.98), "tight": (0.05, 0.95)}, ["l_returnflag"], 2)


# --- features ---------------------------------------------------------------------


@register("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 6) AS l_extendedprice FROM lineitem, q")
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return features.winsorize(li, ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@register("""WITH q AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS e FROM events) SELECT event_id, CASE WHEN value <= e[1] THEN 'VL' WHEN value <= e[2] THEN 'L' WHEN value <= e[3] THEN 'M' WHEN value <= e[4] THEN 'H' ELSE 'VH' END AS value_bin FROM events, q""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.quantile_bins(table(spark, sf_dir, "events"), "value").select("event_id", "value_bin")


@register("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - m) / (s + 1e-8), 6) AS value FROM events, s")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.standardize(table(spark, sf_dir, "events").select("event_id", "value"), ["value"]).withColumn("value", F.round("value", 6))


@register()
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.group_folds(table(spark, sf_dir, "events"), "user_id", 5)


@register("""WITH s AS (SELECT *, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 0 WHEN month(o_orderdate) <= 5 THEN 1 WHEN month(o_orderdate) <= 9 THEN 2 ELSE 3 END AS season FROM orders)
SELECT o_orderkey, round(CASE WHEN avg(o_totalprice) OVER (PARTITION BY o_custkey, season) > 0.01 THEN o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_custkey, season) ELSE 1.0 END, 6) AS ratio FROM s""")
def season_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("season", dates.season_code(F.month("o_orderdate")))
    return o.select("o_orderkey", F.round(features.anomaly_ratio(o, "o_custkey", "season", "o_totalprice"), 6).alias("ratio"))


@register("""WITH b AS (SELECT l_orderkey, l_linenumber, l_shipdate AS d, l_quantity / 100 AS B3, l_discount AS B8, l_tax AS B4, 0.05 AS B2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(B3 + B8) > 1e-10 THEN (B3 - B8) / (B3 + B8) ELSE 0 END, 6) + 0.0 AS ndwi, round(CASE WHEN abs(B8 + B4) > 1e-10 THEN (B8 - B4) / (B8 + B4) ELSE 0 END, 6) + 0.0 AS ndvi,
round(CASE WHEN abs(B3 + B2) > 1e-10 THEN (B8 - B4) / (B3 + B2) ELSE 0 END, 6) + 0.0 AS sabi, round(B8 / greatest(B4, 1e-6), 4) + 0.0 AS b8_b4, round(sin(2 * pi() * month(d) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(d) / 12), 6) + 0.0 AS month_cos,
CASE WHEN month(d) IN (12, 1, 2) THEN 'Winter (Dec-Feb)' WHEN month(d) <= 5 THEN 'Pre-Monsoon (Mar-May)' WHEN month(d) <= 9 THEN 'Monsoon (Jun-Sep)' ELSE 'Post-Monsoon (Oct-Nov)' END AS season FROM b""")
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.lit(0.05)
    bands = {"B2": flat, "B3": F.col("l_quantity") / 100, "B4": F.col("l_tax"), "B5": flat, "B6": flat, "B8": F.col("l_discount"), "B11": flat}
    found, ratios = spectral.indices(bands), spectral.band_ratios(bands)
    sine, cosine = dates.month_cycle(F.month("l_shipdate"))
    r = lambda c, n, d=6: (F.round(c, d) + 0.0).alias(n)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r(found["NDWI"], "ndwi"), r(found["NDVI"], "ndvi"), r(found["SABI"], "sabi"),
        r(ratios["B8_B4"], "b8_b4", 4), r(sine, "month_sin"), r(cosine, "month_cos"), dates.season(F.month("l_shipdate")).alias("season"),
    )


@register("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9)::DOUBLE AS p FROM lineitem GROUP BY 1, 2")
def conditional_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.conditional_shares(table(spark, sf_dir, "lineitem"), "l_linestatus", ["l_returnflag"]).withColumn("p", F.round("p", 9))


@register("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.label_codes(table(spark, sf_dir, "part"), "p_brand", "code").select("p_partkey", "code")


@register("""WITH s AS (SELECT s_suppkey AS a, 20 + s_suppkey * 0.1::DOUBLE AS y, 75 + s_nationkey * 0.5::DOUBLE AS x FROM supplier), h AS (SELECT *, pow(sin(radians(30.99 - y) / 2), 2) + cos(radians(y)) * cos(radians(30.99)) * pow(sin(radians(78.94 - x) / 2), 2) AS h FROM s)
SELECT a, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km, y BETWEEN 6 AND 37 AND x BETWEEN 68 AND 98 AS in_india, CASE WHEN x < 81 THEN 'Upper Ganga' WHEN x < 87 THEN 'Middle Ganga' ELSE 'Lower Ganga' END AS region,
round(sqrt(pow((y - 30.99) * 111, 2) + pow((x - 78.94) * 111 * cos(radians(y)), 2)), 6) AS planar FROM h""")
def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = 20 + F.col("s_suppkey") * 0.1, 75 + F.col("s_nationkey") * 0.5
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("a"), F.round(geo.haversine_km(y, x, F.lit(30.99), F.lit(78.94)), 6).alias("km"), geo.in_india(y, x).alias("in_india"), geo.region(x).alias("region"),
        F.round(geo.distance_from_source_km(y, x), 6).alias("planar"),
    )


# --- parsers ----------------------------------------------------------------------


@register("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity WHEN 2 THEN (l_quantity + l_quantity + 1) / 2 WHEN 3 THEN NULL WHEN 4 THEN l_quantity + 1000 ELSE NULL END::DOUBLE AS value FROM lineitem""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("string"), F.col("l_linenumber") % 6
    raw = (
        F.when(n == 0, q).when(n == 1, F.concat(F.lit(" <"), q)).when(n == 2, F.concat(q, F.lit("-"), (F.col("l_quantity") + 1).cast("string"))).when(n == 3, "BDL")
        .when(n == 4, F.format_number(F.col("l_quantity") + 1000, 1)).otherwise("n/a")
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", parse.safe_float(F.col("raw")).alias("value"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS date FROM orders", iso=("date",))
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 6
    form = lambda f: F.date_format(d, f)
    raw = (
        F.when(n == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, form("dd/MM/yyyy")).when(n == 2, form("dd-MM-yy")).when(n == 3, form("d MMM yyyy"))
        .when(n == 4, F.date_diff(F.to_date(d), F.lit("1899-12-30").cast("date")).cast("string")).otherwise(form("MMM yyyy"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.parse_date(raw).alias("date"))


_NAMES = ["Dissolved Oxygen (mg/L)", "B.O.D.", "Faecal Coliform", "Temp", "Total Hardness as CaCO3", "NO3-N", "Unknown", "E.C."]


@register("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'do' WHEN 1 THEN 'bod' WHEN 2 THEN 'fecal_coliform' WHEN 3 THEN 'temperature' WHEN 4 THEN 'hardness' WHEN 5 THEN 'nitrate' WHEN 7 THEN 'conductivity' END AS parameter FROM part""")
def parameter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.raw_parameter(raw).alias("parameter"))


@register("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Ganga At D/S Kanpur UP' WHEN 1 THEN 'Patna Ghat' WHEN 2 THEN 'WQ Burhi Gandak' ELSE 'O''Brien Nagar' END AS name,
CASE s_suppkey % 4 WHEN 0 THEN 'Ganga' WHEN 1 THEN 'Ganga' WHEN 2 THEN 'Gandak' ELSE 'Ganga basin (unspecified)' END AS river, CASE s_suppkey % 4 WHEN 0 THEN 'ganga at ds kanpur up' WHEN 1 THEN 'patna ghat' WHEN 2 THEN 'burhi gandak' ELSE 'obrien nagar' END AS comparable,
CASE s_suppkey % 2 WHEN 0 THEN 'Uttarakhand' ELSE 'New State' END AS state FROM supplier""")
def station_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, "ganga  at d/s KANPUR UP").when(k == 1, " patna ghat ").when(k == 2, "WQ burhi gandak").otherwise("o'brien nagar")
    state = F.when(F.col("s_suppkey") % 2 == 0, " UTTARANCHAL ").otherwise("new state")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.station_name(raw).alias("name"), text.river_of(raw).alias("river"), text.comparable_name(raw).alias("comparable"), text.state_name(state).alias("state"))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN value * 0.001::DOUBLE WHEN 1 THEN value WHEN 2 THEN value WHEN 3 THEN value END AS value, CASE event_id % 4 WHEN 3 THEN 'furlong' ELSE 'mg/L' END AS unit,
CASE event_id % 4 WHEN 3 THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence FROM events""")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.lit("bod").alias("parameter"), "value", F.when(k == 0, "ug / L").when(k == 1, "").when(k == 2, "ppm").otherwise("furlong").alias("unit"),
        F.lit(0.0).alias("source_value"), F.lit("").alias("source_unit"), F.lit(1.0).alias("confidence"), F.lit("").alias("notes"),
    )
    targets = spark.createDataFrame([("bod", "mg/L")], "parameter string, target_unit string")
    return quality.convert_units(rows, targets).select("event_id", "value", "unit", "confidence")


@register("""SELECT event_id, (json_extract(props, '$.k'))::INT AS k FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.json_fields(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k int")


@register("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = readers.tag_texts(table(spark, sf_dir, "pages").select("page_id", "html"), "html", ["title"], {"paragraphs": "<p>"})
    return pages.drop("html")


@register("""SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.05), 6) AS p5, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.band_statistics(table(spark, sf_dir, "events"), keys=("event_type",))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p5", "p50", "p95")})


from gaugeflow.plans import coverage  # noqa: E402, F401  adds its queries
