"""Business tables seen as facts: graphs, event sequences, field accesses, contexts; each with its SQL twin.

All over whole tables: no row is left out of a relation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Tables of one folder, read on use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _name(kind: str, column: str):
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def links(t: Tables) -> DataFrame:
    """The rows of :func:`hierarchy`, those of several lines repeated: for operators that look for equal edges themselves."""
    parts = [
        t.nation.select(_name("R", "n_regionkey"), _name("N", "n_nationkey")),
        t.customer.select(_name("N", "c_nationkey"), _name("C", "c_custkey")),
        t.orders.select(_name("C", "o_custkey"), _name("O", "o_orderkey")),
        t.lineitem.select(_name("O", "l_orderkey"), _name("P", "l_partkey")),
        t.lineitem.select(_name("P", "l_partkey"), _name("S", "l_suppkey")),
    ]
    return reduce(DataFrame.union, [p.toDF("src", "dst") for p in parts])


def hierarchy(t: Tables) -> DataFrame:
    """(src, dst), acyclic: region R, nation N, customer C, order O, part P, supplier S, each one's rows over the whole tables."""
    return links(t).distinct()


def circuit(t: Tables) -> DataFrame:
    """The hierarchy, and each supplier's nation: cycles; edges of several lines are repeated."""
    return links(t).union(t.supplier.select(_name("S", "s_suppkey"), _name("N", "s_nationkey")))


GRAPH = """
d AS MATERIALIZED (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
  UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem),
e AS MATERIALIZED (SELECT src, dst FROM d UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


def flows(t: Tables) -> DataFrame:
    """(src, dst): nations of which the first sells more to customers of the second than it buys from its suppliers; all pairs that trade."""
    c = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("dst"))
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    line = t.lineitem.select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    g = line.join(s, "l_suppkey").join(c, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.sum("cents").alias("v"))
    back = g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("v").alias("w"))
    return g.join(back, ["src", "dst"], "left").where("v > coalesce(w, 0)").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


FLOWS = """
g AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
f AS MATERIALIZED (SELECT g.src, g.dst FROM g LEFT JOIN g h ON h.src = g.dst AND h.dst = g.src WHERE g.v > coalesce(h.v, 0))"""


def blocks(t: Tables) -> DataFrame:
    """(func, block, k, status, priority): a customer's orders, one after the other, as the blocks of a function."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("func"), F.col("o_orderkey").alias("block"), F.row_number().over(w).alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def control(b: DataFrame) -> DataFrame:
    """(func, src, dst): on to the next block, past it if finished, back to the one before if urgent."""
    to = F.array(F.col("k") + 1, F.when(F.col("status") == "F", F.col("k") + 2), F.when(F.col("priority") == "1-URGENT", F.col("k") - 1))
    hop = b.select("func", F.col("block").alias("src"), F.explode(to).alias("k")).where("k IS NOT NULL")
    return hop.join(b.select("func", "k", F.col("block").alias("dst")), ["func", "k"]).select("func", "src", "dst")


BLOCKS = """
bl AS MATERIALIZED (SELECT o_custkey AS func, o_orderkey AS block, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
ce AS MATERIALIZED (SELECT a.func, a.block AS src, b.block AS dst FROM bl a JOIN bl b ON a.func = b.func AND (b.k = a.k + 1 OR a.status = 'F' AND b.k = a.k + 2 OR a.priority = '1-URGENT' AND b.k = a.k - 1)),
fr AS (SELECT a.func, b.block AS dominator, a.block AS node FROM bl a JOIN bl b ON a.func = b.func AND a.k = 1 AND b.k > 1 UNION SELECT fr.func, dominator, ce.dst FROM fr JOIN ce ON fr.func = ce.func AND fr.node = ce.src WHERE ce.dst <> dominator),
dm AS MATERIALIZED (SELECT a.func, a.block AS node, b.block AS dominator FROM bl a JOIN bl b ON a.func = b.func WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.func = a.func AND fr.node = a.block AND fr.dominator = b.block))"""


def sequences(t: Tables) -> DataFrame:
    """(func, ord, op, event_id): all events of each user and day."""
    func = F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
    w = Window.partitionBy("func").orderBy("ts", "event_id")
    return t.events.select(func.alias("func"), "ts", "event_id", F.col("event_type").alias("op")).withColumn("ord", F.row_number().over(w)).select("func", "ord", "op", "event_id")


SEQUENCES = "t AS MATERIALIZED (SELECT func, row_number() OVER (PARTITION BY func ORDER BY ts, event_id) AS ord, op, event_id FROM (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS func, ts, event_id, event_type AS op FROM events))"


def access(t: Tables) -> DataFrame:
    """(func, struct, field, mode): an order touches the types and return flags of all its lines, and writes those that are open."""
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return line.select(F.col("l_orderkey").alias("func"), F.col("p_type").alias("struct"), F.col("l_returnflag").alias("field"), F.when(F.col("l_linestatus") == "O", "write").otherwise("read").alias("mode")).distinct()


ACCESS = "a AS MATERIALIZED (SELECT DISTINCT l_orderkey AS func, p_type AS struct, l_returnflag AS field, CASE WHEN l_linestatus = 'O' THEN 'write' ELSE 'read' END AS mode FROM lineitem JOIN part ON l_partkey = p_partkey)"


def segments(t: Tables) -> DataFrame:
    """(object, attribute): nations and the market segments in which their mean balance is over the mean of all customers."""
    c = t.customer.select("c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    mean = c.agg((F.sum("cents").cast("double") / F.count(F.lit(1))).alias("mean"))
    g = c.groupBy("c_nationkey", "c_mktsegment").agg((F.sum("cents").cast("double") / F.count(F.lit(1))).alias("own")).crossJoin(mean).where("own > mean")
    return g.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("object"), F.concat(F.substring("c_mktsegment", 1, 4), F.lit("."), "c_mktsegment").alias("attribute"))


SEGMENTS = """k AS (SELECT n_name AS object, substr(c_mktsegment, 1, 4) || '.' || c_mktsegment AS attribute FROM
  (SELECT c_nationkey, c_mktsegment, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) AS own FROM customer GROUP BY 1, 2) JOIN nation ON c_nationkey = n_nationkey
  WHERE own > (SELECT CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) FROM customer))"""
# masks of objects and all closed intents, as concepts (intent, extent, n_attrs, n_objs)
CONCEPTS = """
att AS (SELECT attribute, row_number() OVER (ORDER BY attribute) - 1 AS bit FROM (SELECT DISTINCT attribute FROM k)),
ob AS (SELECT object, bit_or(CAST(1 AS BIGINT) << CAST(bit AS INTEGER)) AS mask FROM (SELECT DISTINCT object, attribute FROM k) JOIN att USING (attribute) GROUP BY object),
cl(mask) AS (SELECT mask FROM ob UNION SELECT bit_or(CAST(1 AS BIGINT) << CAST(bit AS INTEGER)) FROM att UNION SELECT cl.mask & ob.mask FROM cl, ob),
co AS (SELECT mask, coalesce((SELECT list(attribute ORDER BY attribute) FROM att WHERE (cl.mask >> CAST(bit AS INTEGER)) & 1 = 1), []) AS intent,
  coalesce((SELECT list(object ORDER BY object) FROM ob WHERE ob.mask & cl.mask = cl.mask), []) AS extent FROM cl),
c AS (SELECT mask, intent, extent, CAST(len(intent) AS INTEGER) AS n_attrs, CAST(len(extent) AS INTEGER) AS n_objs FROM co)"""


def references(t: Tables) -> DataFrame:
    """(func, ref_pkg, name): an order refers to all its parts, which belong to their brands."""
    line = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return line.select(F.col("l_orderkey").alias("func"), F.col("p_brand").alias("ref_pkg"), _name("p", "l_partkey").alias("name")).distinct()


REFERENCES = "r AS MATERIALIZED (SELECT DISTINCT l_orderkey AS func, p_brand AS ref_pkg, 'p' || l_partkey AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"


def order_sites(t: Tables) -> DataFrame:
    """(site, category) of urgent orders, by status."""
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "open").otherwise("partial")
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("site"), status.alias("category"))


SITES = "s AS (SELECT o_orderkey AS site, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END AS category FROM orders WHERE o_orderpriority = '1-URGENT')"
VERDICT = """v AS (SELECT category, count(*) AS cnt, min(site) AS first_site FROM s GROUP BY category),
rk AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, first_site DESC) AS rn, CAST(sum(cnt) OVER () AS BIGINT) AS total FROM v),
m AS (SELECT category AS pattern, cnt AS adherent, total, round(CAST(cnt AS DOUBLE) / CAST(total AS DOUBLE), 6) AS ratio, CASE WHEN cnt * 2 >= total AND total >= 3 THEN 'strong' ELSE 'weak' END AS status FROM rk WHERE rn = 1)"""
