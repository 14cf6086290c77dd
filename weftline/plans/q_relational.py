"""Relational carriers: grouping, joins, windows and set operations that the pipelines use implicitly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import Registry, load, key_union
from .catalog import query


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
 round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def group_aggregate(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def lookup_joins(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    asia = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(asia, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def top_values(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@query("SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def grouped_sets(spark, sf_dir):
    g = load(spark, sf_dir, "customer").groupBy("c_nationkey")
    return g.agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"), F.count_distinct("c_mktsegment").alias("n")).filter("n > 1")


@query("SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ROLLUP (event_type)")
def rollup_moments(spark, sf_dir):
    e = load(spark, sf_dir, "events").rollup("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")
    )
    return e.withColumn("event_type", F.coalesce("event_type", F.lit("ALL")))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, round(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS before FROM orders")
def running_windows(spark, sf_dir):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    run = F.sum("o_totalprice").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(run, 2).alias("running"), F.round(F.lag("o_totalprice").over(by), 2).alias("before"))


@query("SELECT doc_id AS id, 'documents' AS kind FROM documents UNION ALL SELECT vec_id, 'embeddings' FROM embeddings")
def registry_union(spark, sf_dir):
    r = Registry()
    r.add("documents", lambda: load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("kind")))
    r.add("embeddings", lambda: load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("embeddings").alias("kind")))
    return r.build("documents, embeddings")


@query("SELECT event_type, json_keys(any_value(props)) IS NOT NULL AS has_props, count(json_extract(props, '$')) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    return e.groupBy("event_type").agg(F.bool_and(keys.isNotNull()).alias("has_props"), F.count(F.get_json_object("props", "$")).alias("n"))


@query("SELECT lang, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN lang END, ''), source) AS shown, doc_id FROM documents WHERE n_chars BETWEEN 100 AND 900")
def filter_project(spark, sf_dir):
    d = load(spark, sf_dir, "documents").filter(F.col("n_chars").between(100, 900))
    return d.select("lang", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "source").alias("shown"), "doc_id")


@query("""WITH e AS (SELECT event_type, '{"' || event_type || '": 1, "k": 2}' AS o FROM events UNION ALL SELECT event_type, props FROM events WHERE value > 50 UNION ALL SELECT event_type, '{"u' || user_id % 3 || '": 0}' FROM events)
SELECT event_type, list_sort(list_distinct(flatten(list(json_keys(o))))) AS names FROM e GROUP BY 1""")
def json_key_union(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    own = e.select("event_type", F.concat(F.lit('{"'), "event_type", F.lit('": 1, "k": 2}')).alias("o"))
    user = e.select("event_type", F.concat(F.lit('{"u'), F.col("user_id") % 3, F.lit('": 0}')).alias("o"))
    return key_union(own.unionByName(e.filter("value > 50").select("event_type", F.col("props").alias("o"))).unionByName(user), "o", "event_type")
