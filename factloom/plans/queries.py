"""Queries of the library's operators over the business tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import beliefs as B
from ..operators import concepts as C
from ..operators import domains as D
from ..operators import findings as N
from ..operators import flows as W
from ..operators import kernels as K
from ..operators import paths as P
from ..operators import sites as S
from ..operators import ssa as V
from ..operators import trees as T
from .bindings import ACCESS, BLOCKS, CONCEPTS, FLOWS, GRAPH, REFERENCES, SEGMENTS, SEQUENCES, SITES, VERDICT, Tables, access, blocks, circuit, control, flows, hierarchy, links, order_sites, references, segments, sequences
from .fixpoint import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def users(t: Tables) -> DataFrame:
    return sequences(t).select("func").distinct()


def _id(kind: str, column: str):
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def joined(c: str, alias: str | None = None):
    return F.array_join(c, ",").alias(alias or c)


# beliefs


@query(f"WITH {SITES}, {VERDICT} SELECT category, cnt, first_site FROM v")
def belief_votes(t):
    return B.votes(order_sites(t))


@query(f"WITH {SITES}, {VERDICT} SELECT * FROM m")
def belief_status(t):
    return B.verdict(B.votes(order_sites(t)))


@query(f"WITH {SITES}, {VERDICT} SELECT site, category, pattern FROM s, m WHERE category <> pattern")
def belief_deviations(t):
    s = order_sites(t)
    return B.deviations(s, B.verdict(B.votes(s)))


@query(
    f"WITH {SITES.replace('s AS', 's0 AS')}, {VERDICT.replace(' FROM s ', ' FROM s0 ').replace('m AS', 'm0 AS').replace('v AS', 'v0 AS').replace('rk AS', 'rk0 AS').replace('FROM v)', 'FROM v0)').replace('FROM rk ', 'FROM rk0 ')}, "
    f"s AS (SELECT o_orderkey AS site, CASE WHEN o_totalprice >= 150000 THEN 'large' ELSE 'small' END AS category FROM orders JOIN s0 ON o_orderkey = site, m0 WHERE s0.category <> m0.pattern), {VERDICT} SELECT * FROM m"
)
def belief_sites_from(t):
    """A second belief over the sites that deviate from the first."""
    r = B.Beliefs(t.spark)
    r.define(B.Belief("status", lambda: order_sites(t)))
    r.run()
    size = F.when(F.col("o_totalprice") >= 150000, "large").otherwise("small").alias("category")
    again = r.sites_from("status", "deviation").select("site").join(t.orders.select(F.col("o_orderkey").alias("site"), "o_totalprice"), "site").select("site", size)
    return B.verdict(B.votes(again))


_BY_PRIORITY = """s AS (SELECT o_orderpriority AS name, o_orderkey AS site, o_orderstatus AS category FROM orders),
v AS (SELECT name, category, count(*) AS cnt, min(site) AS first_site FROM s GROUP BY name, category),
rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY cnt DESC, first_site DESC) AS rn, CAST(sum(cnt) OVER (PARTITION BY name) AS BIGINT) AS total FROM v),
m AS (SELECT name, category AS pattern, cnt AS adherent, total, round(CAST(cnt AS DOUBLE) / CAST(total AS DOUBLE), 6) AS ratio, CASE WHEN cnt * 2 >= total AND total >= 3 THEN 'strong' ELSE 'weak' END AS status FROM rk WHERE rn = 1)"""


def _registry(t: Tables) -> B.Beliefs:
    r = B.Beliefs(t.spark)
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        r.define(B.Belief(p, lambda p=p: t.orders.where(F.col("o_orderpriority") == p).select(F.col("o_orderkey").alias("site"), F.col("o_orderstatus").alias("category")), source=f"status of {p}"))
    return r


@query(f"WITH {_BY_PRIORITY} SELECT * FROM m")
def belief_run(t):
    return _registry(t).run().drop("message", "source")


@query(f"WITH {_BY_PRIORITY} SELECT * FROM m WHERE name NOT IN ('2-HIGH', '5-LOW')")
def belief_suppress_known(t):
    known = t.spark.createDataFrame([("status of 2-HIGH",), ("status of 5-LOW",)], "source string")
    return B.suppress_known(_registry(t).run().drop("message"), known).drop("source")


_U = f"WITH {SEQUENCES}, u AS (SELECT DISTINCT func FROM t)"


@query(f"{_U} SELECT func AS site, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.func = u.func AND op IN ('purchase', 'signup')) THEN 'present' ELSE 'absent' END AS category FROM u")
def belief_contains_call(t):
    return B.contains_call(users(t), sequences(t), "purchase", "signup")


@query(f"{_U}, g AS (SELECT func, bool_or(ord % 2 = 0) AS d FROM t WHERE op = 'purchase' GROUP BY func) SELECT func AS site, CASE WHEN d THEN 'paired-defer' WHEN d IS NOT NULL THEN 'paired-call' ELSE 'unpaired' END AS category FROM u LEFT JOIN g USING (func)")
def belief_paired_with(t):
    return B.paired_with(users(t), sequences(t).withColumn("is_defer", F.col("ord") % 2 == 0), "purchase")


@query(f"{_U}, g AS (SELECT func, min(ord) FILTER (op = 'view') AS a, min(ord) FILTER (op = 'purchase') AS b FROM t GROUP BY func) SELECT func AS site, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a <= b THEN 'a-dominates-b' ELSE 'b-dominates-a' END AS category FROM u LEFT JOIN g USING (func)")
def belief_ordered(t):
    return B.ordered(users(t), sequences(t), "view", "purchase")


@query(f"{_U}, g AS (SELECT func, count(*) AS n FROM t WHERE op = 'click' GROUP BY func) SELECT func AS site, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'single' ELSE 'multiple' END AS category FROM u LEFT JOIN g USING (func)")
def belief_single_call(t):
    return B.single_call_site(users(t), sequences(t), "click")


@query(f"WITH {ACCESS} SELECT o_orderkey AS site, CASE n WHEN 2 THEN 'co-mutated' WHEN 1 THEN 'partial' ELSE 'missing' END AS category FROM orders LEFT JOIN (SELECT func, count(DISTINCT field) AS n FROM a WHERE mode = 'write' AND field IN ('N', 'R') GROUP BY func) ON func = o_orderkey")
def belief_co_mutated(t):
    return B.co_mutated(t.orders.select(F.col("o_orderkey").alias("func")), access(t), "N", "R")


@query(f"WITH {ACCESS} SELECT func FROM a WHERE mode = 'write' AND struct = 'PROMO' AND field IN ('N', 'A') GROUP BY func HAVING count(DISTINCT field) = 2")
def stores_to_fields(t):
    return B.stores_to_fields(access(t), "PROMO", "N", "A")


@query(
    f"""WITH {ACCESS}, fs AS (SELECT o_orderkey AS func, CASE o_orderpriority WHEN '1-URGENT' THEN 'PROMO' WHEN '2-HIGH' THEN 'SMALL' WHEN '3-MEDIUM' THEN 'LARGE' WHEN '5-LOW' THEN 'MEDIUM' END AS recv, o_orderstatus AS method FROM orders),
g AS (SELECT fs.func, count(DISTINCT field) FILTER (mode = 'write') AS w, count(DISTINCT field) FILTER (mode = 'read') AS r FROM fs JOIN a ON a.func = fs.func AND a.struct = fs.recv GROUP BY fs.func),
p AS (SELECT l_orderkey AS func, count(*) AS n FROM lineitem GROUP BY 1), im AS (SELECT DISTINCT p_type AS type, CASE WHEN p_size > 49 THEN 'P' ELSE '-' END AS method FROM part), fw AS (SELECT l_orderkey AS func FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
SELECT fs.func AS site, CASE WHEN recv IS NULL THEN 'no-receiver' WHEN coalesce(w, 0) > 0 THEN 'mutation' WHEN coalesce(n, 0) = 0 THEN 'accessor' WHEN coalesce(r, 0) = 0 THEN 'unused-recv' WHEN r > 1 THEN 'multi-read'
WHEN EXISTS (SELECT 1 FROM im WHERE im.type = fs.recv AND im.method = fs.method) THEN 'interface-method' WHEN fs.func IN (SELECT func FROM fw) THEN 'forwarder' ELSE 'candidate' END AS category FROM fs LEFT JOIN g USING (func) LEFT JOIN p USING (func)"""
)
def receiver_asymmetry(t):
    """Orders as methods of the part type that their priority stands for; lines are parameters, one supplier for all makes a forwarder."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "*PROMO").when(F.col("o_orderpriority") == "2-HIGH", "SMALL").when(F.col("o_orderpriority") == "3-MEDIUM", "*LARGE").when(F.col("o_orderpriority") == "5-LOW", "MEDIUM")
    funcs = t.orders.select(F.col("o_orderkey").alias("func"), kind.alias("recv_type"), F.col("o_orderstatus").alias("short_name"))
    params = t.lineitem.select(F.col("l_orderkey").alias("func"))
    interfaces = t.part.select(F.col("p_type").alias("type"), F.when(F.col("p_size") > 49, "P").otherwise("-").alias("method"))
    forwards = t.lineitem.groupBy(F.col("l_orderkey").alias("func")).agg(F.countDistinct("l_suppkey").alias("n")).where("n = 1")
    return B.receiver_asymmetry(B.receiver_facts(funcs, access(t), params, interfaces, forwards))


@query(
    """WITH c AS (SELECT DISTINCT c_nationkey AS type, c_custkey AS member, o_orderpriority AS callee FROM orders JOIN customer ON o_custkey = c_custkey),
z AS (SELECT type, count(DISTINCT member) AS size FROM c GROUP BY type HAVING count(DISTINCT member) >= 5),
u AS (SELECT type, callee FROM c JOIN z USING (type) GROUP BY type, callee, size HAVING count(DISTINCT member) * 5 >= size * 3)
SELECT m.type, m.member, u.callee AS missing FROM (SELECT DISTINCT type, member FROM c) m JOIN u USING (type) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.type = m.type AND c.member = m.member AND c.callee = u.callee)"""
)
def convention_mining(t):
    c = t.orders.select("o_custkey", "o_orderpriority").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return B.conventions(c.select(F.col("c_nationkey").alias("type"), F.col("c_custkey").alias("member"), F.col("o_orderpriority").alias("callee")))


_G = f"WITH RECURSIVE {GRAPH}"


@query(f"{_G}, up AS (SELECT DISTINCT src AS node FROM d JOIN part ON dst = 'P' || p_partkey WHERE p_size = 50 UNION SELECT d.src FROM up JOIN d ON d.dst = up.node) SELECT 'C' || c_custkey AS site, CASE WHEN 'C' || c_custkey IN (SELECT node FROM up) THEN 'reaches' WHEN 'C' || c_custkey IN (SELECT node FROM n) THEN 'unreached' ELSE 'unresolved' END AS category FROM customer")
def belief_reaches_call(t):
    """Whether a customer's orders come to a part of the greatest size."""
    sites = t.customer.select(_id("C", "c_custkey").alias("func"))
    return B.reaches_call(sites, links(t), t.part.where("p_size = 50").select(_id("P", "p_partkey").alias("node")))


@query("SELECT 'O' || o_orderkey AS site, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10) THEN 'guarded' ELSE 'unguarded' END AS category FROM orders")
def belief_checked_before_use(t):
    """Whether an order leads to a small part in a step."""
    k = _id("O", "o_orderkey")
    return B.checked_before_use(t.orders.select(k.alias("site"), k.alias("node")), hierarchy(t), t.part.where("p_size <= 10").select(_id("P", "p_partkey").alias("node")), fuel=2)


# formal concepts

_K = f"WITH RECURSIVE {SEGMENTS}, {CONCEPTS}"


@query(f"WITH {SEGMENTS} SELECT DISTINCT object, attribute FROM k")
def fca_context(t):
    return C.context(segments(t))


@query(f"WITH {SEGMENTS}, o AS (SELECT DISTINCT object FROM k JOIN nation ON object = n_name WHERE n_regionkey = 2) SELECT attribute FROM k JOIN o USING (object) GROUP BY attribute HAVING count(*) = (SELECT count(*) FROM o)")
def fca_intent(t):
    """What the nations of a region have in common."""
    k = checkpointed(C.context(segments(t)))
    own = t.nation.where("n_regionkey = 2").select(F.col("n_name").alias("object"))
    return C.intent(k, k.select("object").distinct().join(own, "object", "left_semi"))


@query(f"WITH {SEGMENTS}, o AS (SELECT DISTINCT attribute FROM k WHERE attribute IN ('AUTO.AUTOMOBILE', 'BUIL.BUILDING')) SELECT object FROM k JOIN o USING (attribute) GROUP BY object HAVING count(*) = 2")
def fca_extent(t):
    """Nations that are strong in two given segments."""
    k = checkpointed(C.context(segments(t)))
    return C.extent(k, t.spark.createDataFrame([("AUTO.AUTOMOBILE",), ("BUIL.BUILDING",)], "attribute string"))


def _lattice(t: Tables) -> DataFrame:
    return checkpointed(C.concepts(C.context(segments(t))))


@query(f"{_K} SELECT array_to_string(intent, ',') AS intent, array_to_string(extent, ',') AS extent, n_attrs, n_objs FROM c")
def fca_concepts(t):
    return _lattice(t).select(joined("intent"), joined("extent"), "n_attrs", "n_objs")


@query(f"{_K} SELECT array_to_string(x.intent, ',') AS a, array_to_string(y.intent, ',') AS b, CASE WHEN x.mask = y.mask THEN 'equal' WHEN x.mask & y.mask = y.mask THEN 'subconcept' WHEN x.mask & y.mask = x.mask THEN 'superconcept' ELSE 'incomparable' END AS relationship FROM c x, c y")
def fca_relationship(t):
    c = _lattice(t).select("intent")
    return c.select(F.col("intent").alias("ia")).crossJoin(c.select(F.col("intent").alias("ib"))).select(joined("ia", "a"), joined("ib", "b"), C.relationship("ia", "ib").alias("relationship"))


_CROSS = "x AS (SELECT *, list_sort(list_distinct(list_transform(intent, lambda a: split_part(a, '.', 1)))) AS types FROM c WHERE n_objs >= 2 AND n_attrs >= 2), y AS (SELECT * FROM x WHERE len(types) >= 2)"


@query(f"{_K}, {_CROSS} SELECT array_to_string(types, '+') AS types, array_to_string(list_transform(types, lambda s: s || '{{' || array_to_string(list_transform(list_filter(intent, lambda a: split_part(a, '.', 1) = s), lambda a: split_part(a, '.', 2)), ',') || '}}'), ';') AS fields, array_to_string(extent, ',') AS functions, n_objs AS extent_size FROM y")
def fca_cross_boundary(t):
    return C.boundary_report(C.cross_boundary(_lattice(t)))


@query(
    f"""{_K}, {_CROSS} SELECT array_to_string(a.intent, ',') AS intent, array_to_string(a.types, '+') AS summary, count(*) FILTER (a.mask <> b.mask AND a.mask & b.mask = b.mask) AS subconcept_of,
count(*) FILTER (a.mask <> b.mask AND a.mask & b.mask = a.mask) AS superconcept_of, count(*) FILTER (a.mask & b.mask NOT IN (a.mask, b.mask)) AS incomparable_with FROM y a, y b GROUP BY ALL"""
)
def fca_annotated(t):
    return C.annotated_report(C.cross_boundary(_lattice(t))).select(joined("intent"), "summary", "subconcept_of", "superconcept_of", "incomparable_with")


@query(f"WITH {ACCESS} SELECT DISTINCT func AS object, struct || '.' || field AS attribute FROM a WHERE mode = 'write' AND func IN (SELECT func FROM a WHERE mode = 'write' GROUP BY func HAVING count(DISTINCT struct) >= 2)")
def fca_field_context(t):
    return C.field_context(access(t), cross_type_only=True)


@query(
    f"""{_G}, {ACCESS}, w AS (SELECT DISTINCT 'O' || func AS func, struct || '.' || field AS attribute FROM a WHERE mode = 'write'),
pw AS (SELECT func, attribute FROM w UNION SELECT d.src, attribute FROM pw JOIN d ON d.dst = pw.func) SELECT func, attribute FROM pw"""
)
def propagate_writes(t):
    """All fields that orders write, and so their customers, nations and regions."""
    own = access(t).where("mode = 'write'").select(F.concat(F.lit("O"), F.col("func").cast("string")).alias("func"), F.concat_ws(".", "struct", "field").alias("attribute"))
    return C.propagate_writes(own, links(t))


# splits


@query(f"WITH {REFERENCES} SELECT DISTINCT func, ref_pkg FROM r")
def import_signatures(t):
    return C.import_signatures(references(t))


_IDF = f"WITH {REFERENCES}, sg AS (SELECT DISTINCT func, ref_pkg FROM r), w AS (SELECT ref_pkg, count(*) AS df, ln(CAST((SELECT count(*) FROM orders) AS DOUBLE) / count(*)) AS idf FROM sg GROUP BY ref_pkg)"


def _idf(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = references(t)
    sg = C.import_signatures(r)
    return r, sg, C.idf(sg, t.orders.select(F.col("o_orderkey").alias("func")))


@query(f"{_IDF} SELECT ref_pkg, df, round(idf, 6) AS idf FROM w")
def idf(t):
    return _idf(t)[2].withColumn("idf", F.round("idf", 6))


@query(f"{_IDF} SELECT func, ref_pkg FROM sg JOIN w USING (ref_pkg) WHERE idf >= 1.9")
def filter_noise(t):
    _, sg, w = _idf(t)
    return C.filter_noise(sg, w, 1.9)


@query(f"{_IDF} SELECT DISTINCT func AS object, ref_pkg || ':' || name AS attribute FROM r JOIN w USING (ref_pkg) WHERE idf >= 1.9")
def refine_api(t):
    r, _, w = _idf(t)
    return C.refine_by_api(r, w.where("idf >= 1.9"))


_SPLIT = """b2 AS (SELECT * FROM c WHERE n_objs > 1), pr AS (SELECT x.intent AS ia, y.intent AS ib, x.extent AS ea, y.extent AS eb, x.mask AS ma, y.mask AS mb FROM b2 x, b2 y
 WHERE array_to_string(x.intent, ',') < array_to_string(y.intent, ',') AND NOT list_has_all(y.extent, x.extent) AND NOT list_has_all(x.extent, y.extent)
 ORDER BY least(len(ea), len(eb)) DESC, len(list_distinct(list_concat(ea, eb))) DESC, array_to_string(ia, ','), array_to_string(ib, ',') LIMIT 1),
sd AS (SELECT object, CASE WHEN list_contains(ea, object) AND list_contains(eb, object) THEN 'cut' WHEN list_contains(ea, object) THEN 'a' WHEN list_contains(eb, object) THEN 'b'
 WHEN bit_count(mask & ma) > bit_count(mask & mb) THEN 'a' WHEN bit_count(mask & ma) < bit_count(mask & mb) THEN 'b' ELSE 'cut' END AS side FROM ob, pr)"""


@query(f"{_K}, {_SPLIT} SELECT object, side FROM sd")
def find_split(t):
    return C.find_split(C.context(segments(t)))


_NREF = "rf AS (SELECT x.n_name AS func, y.n_name AS name FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1)"


def _refs(t: Tables) -> DataFrame:
    n = t.nation
    return n.select(F.col("n_name").alias("func"), (F.col("n_nationkey") + 1).alias("k")).join(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")), "k").select("func", "name")


_ACYC = "ac AS (SELECT count(DISTINCT rf.func) FILTER (x.side = 'a' AND y.side = 'b') AS a_refs_b, count(DISTINCT rf.func) FILTER (x.side = 'b' AND y.side = 'a') AS b_refs_a FROM rf JOIN sd x ON x.object = rf.func JOIN sd y ON y.object = rf.name)"


@query(f"{_K}, {_SPLIT}, {_NREF}, {_ACYC} SELECT *, a_refs_b = 0 OR b_refs_a = 0 AS acyclic FROM ac")
def verify_acyclic(t):
    return C.verify_acyclic(checkpointed(C.find_split(C.context(segments(t)))), _refs(t))


@query(
    f"""{_K}, {_SPLIT}, {_NREF}, {_ACYC}, g AS (SELECT count(*) AS functions, count(*) FILTER (side = 'a') AS group_a, count(*) FILTER (side = 'b') AS group_b, count(*) FILTER (side = 'cut') AS cut FROM sd)
SELECT functions, group_a, group_b, cut, round(CAST(cut AS DOUBLE) / functions, 6) AS cut_ratio, a_refs_b = 0 OR b_refs_a = 0 AS acyclic,
CASE WHEN group_a = 0 OR group_b = 0 THEN 'NONE' WHEN (a_refs_b = 0 OR b_refs_a = 0) AND cut * 100 <= functions * 15 THEN 'HIGH' WHEN (a_refs_b = 0 OR b_refs_a = 0) AND cut * 10 <= functions * 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM g, ac"""
)
def recommend_split(t):
    return C.recommend_split(C.context(segments(t)), _refs(t))


# recommendations

_FACT = "f AS (SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, -CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount FROM lineitem GROUP BY l_suppkey), fr AS (SELECT * FROM f r WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.revenue >= r.revenue AND o.quantity >= r.quantity AND o.discount >= r.discount AND (o.revenue > r.revenue OR o.quantity > r.quantity OR o.discount > r.discount)))"


def _factors(t: Tables) -> DataFrame:
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return t.lineitem.groupBy("l_suppkey").agg(cents("l_extendedprice").alias("revenue"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), (-cents("l_discount")).alias("discount"))


@query(f"WITH {_FACT} SELECT * FROM fr")
def pareto_frontier(t):
    return C.pareto_frontier(checkpointed(_factors(t)), ["revenue", "quantity", "discount"])


@query(f"WITH {_FACT} SELECT r.l_suppkey, min(o.l_suppkey) AS dominator FROM f r JOIN fr o ON o.revenue >= r.revenue AND o.quantity >= r.quantity AND o.discount >= r.discount AND (o.revenue > r.revenue OR o.quantity > r.quantity OR o.discount > r.discount) GROUP BY r.l_suppkey")
def pareto_dominated(t):
    return C.pareto_dominated(checkpointed(_factors(t)), "l_suppkey", ["revenue", "quantity", "discount"])


@query(
    f"""{_K}, ex AS (SELECT mask, n_objs, n_attrs, unnest(extent) AS func FROM c WHERE n_objs < (SELECT max(n_objs) FROM c) AND n_attrs > 0),
p AS (SELECT x.func, round(1 - CAST(bit_count(x.mask & y.mask) AS DOUBLE) / bit_count(x.mask | y.mask), 6) AS dj, round(CAST(least(x.n_objs, y.n_objs) AS DOUBLE) / greatest(x.n_objs, y.n_objs), 6) AS bl FROM ex x JOIN ex y ON x.func = y.func AND x.mask < y.mask AND x.mask & y.mask NOT IN (x.mask, y.mask))
SELECT func, count(*) AS pairs, max(dj) AS disjointness, max(bl) AS balance FROM p GROUP BY func"""
)
def split_candidates(t):
    return C.split_candidates(_lattice(t))


@query(f"{_K}, tc AS (SELECT mask, bit_or(o.m) AS touched FROM (SELECT mask, unnest(extent) AS object FROM c) JOIN (SELECT object, mask AS m FROM ob) o USING (object) GROUP BY mask) SELECT array_to_string(intent, ',') AS intent, n_objs AS extent_count, round(CAST(n_attrs AS DOUBLE) / bit_count(touched), 6) AS intent_overlap FROM c JOIN tc USING (mask) WHERE n_objs >= 2 AND n_attrs > 0")
def merge_candidates(t):
    ctx = checkpointed(C.context(segments(t)))
    return C.merge_candidates(checkpointed(C.concepts(ctx)), ctx).withColumn("intent", joined("intent"))


@query(
    f"""{_K} SELECT intent, narrow, extent_ratio, intent_size FROM (SELECT array_to_string(a.intent, ',') AS intent, array_to_string(b.intent, ',') AS narrow, round(CAST(b.n_objs AS DOUBLE) / a.n_objs, 6) AS extent_ratio, a.n_attrs AS intent_size,
row_number() OVER (PARTITION BY a.mask ORDER BY b.n_objs DESC, array_to_string(b.intent, ',')) AS rn FROM c a JOIN c b ON a.mask <> b.mask AND a.mask & b.mask = a.mask WHERE a.n_attrs > 0 AND a.n_objs > 0 AND b.n_objs > 0) WHERE rn = 1"""
)
def extract_candidates(t):
    return C.extract_candidates(_lattice(t)).withColumns({"intent": joined("intent"), "narrow": joined("narrow")})


# graphs


def _regions(t: Tables) -> DataFrame:
    return t.region.select(_id("R", "r_regionkey").alias("node"))


@query(f"{_G}, cl AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS node FROM region UNION SELECT cl.root, e.dst FROM cl JOIN e ON cl.node = e.src) SELECT root, node FROM cl WHERE root IN (SELECT node FROM n)")
def reachable(t):
    """What each region reaches in the cyclic graph."""
    return P.reachable(circuit(t), _regions(t))


@query(f"{_G}, up AS (SELECT 'S' || s_suppkey AS root, 'S' || s_suppkey AS node FROM supplier WHERE s_acctbal < 0 UNION SELECT root, d.src FROM up JOIN d ON d.dst = up.node WHERE d.src NOT LIKE 'C%') SELECT root, node FROM up WHERE root IN (SELECT dst FROM d)")
def reaching(t):
    """The parts and orders on whose way a supplier in debt lies."""
    d = hierarchy(t).where("src NOT LIKE 'C%' AND src NOT LIKE 'N%' AND src NOT LIKE 'R%'")
    return P.reaching(checkpointed(d), t.supplier.where("s_acctbal < 0").select(_id("S", "s_suppkey").alias("node")))


@query(f"{_G}, cl AS (SELECT 'N3' AS node UNION SELECT d.dst FROM cl JOIN d ON cl.node = d.src) SELECT node FROM cl")
def list_deps(t):
    """All that one nation leads to."""
    one = t.nation.where("n_nationkey = 3").select(_id("N", "n_nationkey").alias("node"))
    return P.reachable(links(t), one).select("node").orderBy("node")


# the cycles are those through nations: what a nation reaches and what reaches it back
_SCC = f"""{_G}, dn AS (SELECT 'N' || n_nationkey AS root, 'N' || n_nationkey AS node FROM nation UNION SELECT dn.root, e.dst FROM dn JOIN e ON dn.node = e.src),
up AS (SELECT 'N' || n_nationkey AS root, 'N' || n_nationkey AS node FROM nation UNION SELECT up.root, e.src FROM up JOIN e ON up.node = e.dst),
mu AS MATERIALIZED (SELECT root, node FROM dn JOIN up USING (root, node)), lo AS (SELECT root, min(node) AS component, count(*) AS size FROM mu GROUP BY root),
sc AS MATERIALIZED (SELECT node, min(component) AS component, max(size) AS size FROM mu JOIN lo USING (root) GROUP BY node)"""


@query(f"{_SCC} SELECT node, coalesce(component, node) AS component FROM n LEFT JOIN sc USING (node)")
def sccs(t):
    return P.components(circuit(t))


@query(f"{_SCC} SELECT node FROM sc WHERE size > 1")
def cyclic_nodes(t):
    return P.cyclic_nodes(circuit(t))


@query(f"{_G}, tr AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS node, CAST(0 AS BIGINT) AS distance FROM region UNION SELECT root, e.dst, distance + 1 FROM tr JOIN e ON tr.node = e.src WHERE distance < 12) SELECT root, node, min(distance) AS distance FROM tr WHERE root IN (SELECT node FROM n) GROUP BY root, node")
def tropical_paths(t):
    """Steps from each region, suppliers leading on to their nations."""
    return P.tropical(circuit(t), _regions(t))


@query(f"{_G}, pt AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS node FROM region UNION ALL SELECT root, d.dst FROM pt JOIN d ON pt.node = d.src) SELECT root, node, count(*) AS paths FROM pt WHERE root IN (SELECT src FROM d) GROUP BY root, node")
def count_paths(t):
    """In how many ways each region comes to an order, a part, a supplier."""
    return P.count_paths(hierarchy(t), _regions(t)).withColumn("paths", F.col("paths").cast("long"))


_B = f"WITH RECURSIVE {BLOCKS}"


def _dominance(t: Tables) -> tuple[DataFrame, DataFrame]:
    b = blocks(t)
    entry = b.where("k = 1").select("func", F.col("block").alias("node"))
    return control(b), entry


@query(f"{_B} SELECT func, node, dominator FROM dm")
def cfg_dominators(t):
    """Every customer's orders as a function's blocks."""
    return K.dominators(*_dominance(t))


@query(f"{_B}, dp AS (SELECT func, node, count(*) AS depth FROM dm GROUP BY func, node) SELECT dm.func, dm.node, arg_max(dm.dominator, dp.depth) AS idom FROM dm JOIN dp ON dp.func = dm.func AND dp.node = dm.dominator WHERE dm.node <> dm.dominator GROUP BY dm.func, dm.node")
def cfg_idom(t):
    return K.idoms(*_dominance(t))


@query(
    f"""{_B}, aa AS (SELECT func, block FROM bl WHERE priority = '2-HIGH'), bb AS (SELECT func, block FROM bl WHERE priority = '5-LOW'),
ok AS (SELECT bb.func, count(*) AS nb, count(*) FILTER (EXISTS (SELECT 1 FROM dm JOIN aa ON aa.func = dm.func AND aa.block = dm.dominator WHERE dm.func = bb.func AND dm.node = bb.block)) AS good FROM bb GROUP BY bb.func)
SELECT c_custkey AS site, CASE WHEN nb IS NULL OR c_custkey NOT IN (SELECT func FROM aa) THEN 'missing' WHEN good = nb THEN 'dominates-all' WHEN good > 0 THEN 'partial' ELSE 'none' END AS category FROM customer LEFT JOIN ok ON ok.func = c_custkey"""
)
def dominates_call(t):
    """Whether a customer's orders of low priority come after one of high priority on all ways."""
    ops = blocks(t).where("priority IN ('2-HIGH', '5-LOW')").select("func", "block", F.col("priority").alias("op"))
    return B.dominates_call(t.customer.select(F.col("c_custkey").alias("func")), ops, K.dominators(*_dominance(t)), "2-HIGH", "5-LOW")


@query(f"{_G}, pt AS (SELECT ['N3'] AS p UNION ALL SELECT list_append(p, d.dst) FROM pt JOIN d ON p[-1] = d.src) SELECT array_to_string(p, '>') AS path FROM pt WHERE p[-1] = 'S1'")
def cfg_paths(t):
    """All ways from a nation to a supplier."""
    return P.simple_paths(links(t), "N3", "S1", 10).select(F.array_join("path", ">").alias("path"))


@query(f"WITH {GRAPH} SELECT src, dst FROM e WHERE dst = 'P7'")
def callers(t):
    return P.callers(circuit(t), "P7")


@query(f"WITH {GRAPH} SELECT src, dst FROM e WHERE src = 'P7'")
def callees(t):
    return P.callees(circuit(t), "P7")


# dataflow


@query(f"{_G}, st AS (SELECT 'C' || c_custkey AS root, 'C' || c_custkey AS node, 0 AS k FROM customer UNION SELECT root, d.dst, k + 1 FROM st JOIN d ON st.node = d.src WHERE k < 2) SELECT DISTINCT root, node FROM st")
def defuse_reach_fuel(t):
    """Orders and parts within two steps of every customer."""
    return W.defuse_reachable(links(t), t.customer.select(_id("C", "c_custkey").alias("node")), 2)


@query(f"{_G}, b AS MATERIALIZED (SELECT src, dst FROM d WHERE src[1] IN ('N', 'C', 'O') UNION SELECT src, dst FROM d WHERE src[1] = 'P'), st AS (SELECT 'N' || n_nationkey AS root, 'N' || n_nationkey AS node FROM nation UNION SELECT root, b.dst FROM st JOIN b ON st.node = b.src) SELECT root, node FROM st WHERE root IN (SELECT src FROM b)")
def value_flow(t):
    """What comes from each nation's customers, parts being stored with their suppliers."""
    d = checkpointed(hierarchy(t))
    kind = F.substring("src", 1, 1)
    stores = d.where(kind == "P").select(F.col("src").alias("value"), F.col("dst").alias("aggregate"))
    return W.value_flow(d.where(kind.isin("N", "C", "O")), stores, t.nation.select(_id("N", "n_nationkey").alias("node")))


@query(f"{_B}, rd AS (SELECT ce.func, ce.dst AS block, bl.priority AS name FROM ce JOIN bl ON bl.func = ce.func AND bl.block = ce.src UNION SELECT ce.func, ce.dst, rd.name FROM rd JOIN ce ON ce.func = rd.func AND ce.src = rd.block) SELECT func, block, name FROM rd")
def reaching_defs(t):
    """The priorities of orders before each of a customer's orders."""
    b = blocks(t)
    gen = b.select("func", "block", F.col("priority").alias("name"))
    return K.gen_kill(control(b), gen, gen.limit(0))


@query(f"{_B}, lv AS (SELECT func, block, priority AS name FROM bl WHERE status = 'O' UNION SELECT ce.func, ce.src, lv.name FROM lv JOIN ce ON ce.func = lv.func AND ce.dst = lv.block JOIN bl ON bl.func = ce.func AND bl.block = ce.src WHERE NOT (bl.status = 'F' AND bl.priority = lv.name)) SELECT func, block, name FROM lv")
def liveness(t):
    """Priorities used by an open order ahead before a finished one ends them."""
    b = blocks(t)
    named = b.select("func", "block", F.col("priority").alias("name"), "status")
    return K.gen_kill(control(b), named.where("status = 'O'"), named.where("status = 'F'"), forward=False)


_PTS = f"""{_G}, cp AS MATERIALIZED (SELECT src, dst FROM d WHERE src[1] IN ('C', 'O')), pt AS (SELECT DISTINCT src AS value, src AS site FROM cp WHERE src[1] = 'C' UNION SELECT 'C' || c_custkey, '?' FROM customer WHERE c_acctbal < {{least}} UNION SELECT cp.dst, pt.site FROM pt JOIN cp ON pt.value = cp.src)"""


def _points(t: Tables, least: int) -> DataFrame:
    """Customers as allocations, carried to their orders and parts; those with less on account may be anything."""
    cp = links(t).where(F.substring("src", 1, 1).isin("C", "O"))
    own = cp.where("src LIKE 'C%'").select(F.col("src").alias("value"), F.col("src").alias("site")).distinct()
    return W.points_to(cp, own, t.customer.where(F.col("c_acctbal") < least).select(_id("C", "c_custkey").alias("value")))


@query(f"{_PTS.replace('{least}', '0')} SELECT value, site FROM pt")
def points_to(t):
    return _points(t, 0)


@query(
    f"""{_PTS.replace('{least}', '-5000')}, lk AS (SELECT DISTINCT 'P' || l_partkey AS value, l_suppkey AS func FROM lineitem), ro AS (SELECT s_suppkey AS func, s_nationkey AS root FROM supplier), aa AS (SELECT lk.func, site FROM lk JOIN pt USING (value))
SELECT site, count(DISTINCT root) AS roots, CASE WHEN EXISTS (SELECT 1 FROM aa WHERE site = '?') THEN 'unbounded' ELSE CAST(count(DISTINCT root) AS VARCHAR) END AS measure FROM aa LEFT JOIN ro USING (func) WHERE site <> '?' GROUP BY site"""
)
def lock_escape(t):
    """How many nations' suppliers lock the parts that a customer's orders come to."""
    locks = t.lineitem.select(F.col("l_suppkey").alias("func"), _id("P", "l_partkey").alias("value")).distinct()
    return W.lock_escape(locks, _points(t, -5000), t.supplier.select(F.col("s_suppkey").alias("func"), F.col("s_nationkey").alias("root")))


# calls and returns

# the bracket closure in rounds of squaring; 25 nations need no more of them
_VALID = (
    f"WITH RECURSIVE {FLOWS}, c AS MATERIALIZED (SELECT src, dst, dst % 3 AS id FROM f), b0 AS MATERIALIZED (SELECT src, src AS dst FROM c UNION SELECT dst, dst FROM c), "
    + ", ".join(f"b{i + 1} AS MATERIALIZED (SELECT src, dst FROM b{i} UNION SELECT x.src, y.src FROM c x JOIN b{i} m ON x.dst = m.src JOIN c y ON m.dst = y.dst AND x.id = y.id UNION SELECT l.src, r.dst FROM b{i} l JOIN b{i} r ON l.dst = r.src)" for i in range(8))
    + ", up AS (SELECT src, dst FROM b0 UNION SELECT up.src, r.dst FROM up JOIN (SELECT src, dst FROM b8 UNION SELECT dst, src FROM c) r ON up.dst = r.src), dn AS (SELECT src, dst FROM up UNION SELECT dn.src, r.dst FROM dn JOIN (SELECT src, dst FROM b8 UNION SELECT src, dst FROM c) r ON dn.dst = r.src) SELECT src, dst FROM dn"
)


@query(_VALID)
def valid_paths(t):
    """Among nations, by where goods flow; calls of the same id may return to each other's callers."""
    return W.valid_paths(checkpointed(flows(t).withColumn("id", F.col("dst") % 3)))


# every edge is a call site of its own, so a valid path returns to callers and then calls
def _taint(rule: str) -> str:
    return f"""{_G}, c AS MATERIALIZED (SELECT src, dst FROM d WHERE src[1] IN ('C', 'O'){rule}),
sc AS MATERIALIZED (SELECT 'P' || p_partkey AS node FROM part WHERE p_type = 'PROMO' AND p_size = 1), sk AS MATERIALIZED (SELECT 'P' || p_partkey AS node FROM part WHERE p_type = 'SMALL'),
up AS (SELECT node AS src, node AS dst FROM sc WHERE node IN (SELECT dst FROM c) UNION SELECT up.src, c.src FROM up JOIN c ON up.dst = c.dst),
dn AS (SELECT src, dst FROM up UNION SELECT dn.src, c.dst FROM dn JOIN c ON dn.dst = c.src) SELECT src AS source, dst AS sink FROM dn JOIN sk ON dst = node"""


def _tainted(t: Tables, clean: DataFrame | None = None) -> DataFrame:
    c = links(t).where(F.substring("src", 1, 1).isin("C", "O")).withColumn("id", F.concat_ws(">", "src", "dst"))
    node = _id("P", "p_partkey").alias("node")
    return W.taint_flows(c, t.part.where("p_type = 'PROMO' AND p_size = 1").select(node), t.part.where("p_type = 'SMALL'").select(node), clean)


@query(_taint(""))
def taint_flows(t):
    """Small parts that some customer bought who also bought a given kind of promoted parts."""
    return _tainted(t)


@query(_taint(" AND dst NOT IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderstatus = 'F') AND src NOT IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def taint_sanitized(t):
    """The same, finished orders being clean."""
    return _tainted(t, t.orders.where("o_orderstatus = 'F'").select(_id("O", "o_orderkey").alias("node")))


_SITE = "st AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, list_sort(list_distinct(list(l_suppkey))) AS cs FROM lineitem GROUP BY l_orderkey)"


def _sites(t: Tables) -> DataFrame:
    return W.dispatch_sites(t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("candidate")), ["l_orderkey"])


@query(f"WITH {_SITE} SELECT o_orderkey AS l_orderkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'must' ELSE 'may' END AS class, CASE WHEN n > 8 THEN 'elided' ELSE 'full' END AS detail, CASE WHEN coalesce(n, 0) <= 8 THEN array_to_string(cs, ',') END AS candidates FROM orders LEFT JOIN st ON l_orderkey = o_orderkey")
def dispatch_sites(t):
    e = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("candidate"))
    out = W.dispatch_sites(e, ["l_orderkey"], every=t.orders.select(F.col("o_orderkey").alias("l_orderkey")))
    return out.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))


@query(f"WITH {_SITE} SELECT class, count(*) AS sites, CAST(max(n) AS BIGINT) AS most FROM (SELECT *, CASE WHEN n = 1 THEN 'must' ELSE 'may' END AS class FROM st) GROUP BY class")
def dispatch_class(t):
    return _sites(t).groupBy("class").agg(F.count(F.lit(1)).alias("sites"), F.max("n").alias("most"))


_NARROWED = f"WITH {_SITE}, wd AS (SELECT l_orderkey, count(DISTINCT s) AS narrowed_from FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem) USING (l_partkey) GROUP BY l_orderkey)"


@query(f"{_NARROWED} SELECT l_orderkey, n, narrowed_from FROM st LEFT JOIN wd USING (l_orderkey)")
def dispatch_narrowed_from(t):
    line = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("candidate"))
    return W.narrowed_by(_sites(t), line, line, ["l_orderkey"], "l_partkey").select("l_orderkey", "n", "narrowed_from")


@query(f"WITH {FLOWS}, mk AS (SELECT CAST(s_nationkey AS BIGINT) AS dst, array_to_string(list_sort(list_distinct(list(s_name))), ',') AS witness FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT src, dst, witness FROM f LEFT JOIN mk USING (dst)")
def witness(t):
    makers = t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").cast("long").alias("dst"), F.col("s_name").alias("pos"))
    return W.witnesses(flows(t), makers, "dst").select("src", "dst", joined("witness"))


@query(
    f"""{_G}, bk AS MATERIALIZED (SELECT src, dst FROM d UNION SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
lo AS (SELECT DISTINCT 'C' || o_custkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' UNION SELECT bk.src FROM lo JOIN bk ON bk.dst = lo.node),
ty AS (SELECT 'S' || s_suppkey AS node, 'nation' || s_nationkey AS type FROM supplier WHERE 'S' || s_suppkey IN (SELECT dst FROM d) UNION SELECT bk.src, type FROM ty JOIN bk ON bk.dst = ty.node),
tl AS (SELECT node, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM ty GROUP BY node), nd AS (SELECT src AS node FROM bk UNION SELECT dst FROM bk)
SELECT nd.node, CASE WHEN nd.node IN (SELECT node FROM lo) THEN 'widened' WHEN types IS NULL THEN 'no-paths' ELSE 'narrow' END AS confidence, coalesce(types, '') AS types FROM nd LEFT JOIN tl USING (node)"""
)
def narrow_types(t):
    """The suppliers' nations that everything comes to; urgent orders of partial status lead back to their customers."""
    back = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(_id("O", "o_orderkey").alias("src"), _id("C", "o_custkey").alias("dst"))
    ends = t.supplier.select(_id("S", "s_suppkey").alias("node"), _id("nation", "s_nationkey").alias("type"))
    return W.narrow(links(t).union(back), ends).withColumn("types", joined("types"))


# sites: orders as methods of their customers, named by their priority


def _functions(t: Tables) -> DataFrame:
    return t.orders.select(_id("O", "o_orderkey").alias("func"), F.col("o_orderpriority").alias("short_name"), F.col("o_orderstatus").alias("pkg"), _id("*C", "o_custkey").alias("recv_type"))


def _interface(t: Tables) -> tuple[DataFrame, DataFrame]:
    methods = t.orders.select(_id("C", "o_custkey").alias("type"), F.col("o_orderpriority").alias("method")).distinct()
    return methods, t.spark.createDataFrame([("Hurried", "p", "1-URGENT"), ("Hurried", "p", "2-HIGH")], "iface string, pkg string, method string")


_HURRIED = "hu AS (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 2)"


@query("SELECT DISTINCT 'O' || l_orderkey AS func FROM lineitem WHERE l_partkey = 7")
def sites_callers_of(t):
    return S.callers_of(_functions(t), hierarchy(t), "P7").select("func")


@query("SELECT 'O' || o_orderkey AS func FROM orders WHERE CAST(o_custkey AS VARCHAR) LIKE '%77%' AND o_orderstatus = 'F'")
def sites_methods_of(t):
    return S.all_functions_in(S.functions_matching(_functions(t), F.col("recv_type").rlike("^.C[0-9]*77")), "F").select("func")


@query(f"WITH {_HURRIED} SELECT 'C' || o_custkey AS impl_type, 'O' || o_orderkey AS func FROM orders JOIN hu USING (o_custkey)")
def sites_implementors_of(t):
    return S.implementors_of(_functions(t), *_interface(t), "Hurried").select("impl_type", "func")


@query(f"WITH {_HURRIED} SELECT 'C' || o_custkey AS impl_type, 'O' || o_orderkey AS func, o_orderpriority AS short_name FROM orders JOIN hu USING (o_custkey) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def sites_interface_methods(t):
    return S.interface_methods(_functions(t), *_interface(t), "p.Hurried").select("impl_type", "func", "short_name")


# instructions: an order's open lines make values of their part's type, its finished ones are parameters, and one phi joins them

_OPEN = "op AS (SELECT l_orderkey, p_type, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey)"
_INS = "func string, block int, ord int, tag string, name string, concrete string, type string, operands array<string>, callee string, method string, recv string, addr string, val string, struct string, field string, pos string"


def _program(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    name = F.concat_ws("_", F.lit("v"), "l_linenumber", "l_partkey", "l_linestatus")
    made = F.col("l_linestatus") == "O"
    own = line.select(_id("O", "l_orderkey").alias("func"), F.when(made, "ssa-make-interface").otherwise("ssa-param").alias("tag"), name.alias("name"), F.when(made, F.col("p_type")).alias("concrete")).distinct()
    phi = own.groupBy("func").agg(F.sort_array(F.collect_set("name")).alias("operands")).select("func", F.lit("ssa-phi").alias("tag"), F.lit("r").alias("name"), "operands")
    call = phi.select("func", F.lit("ssa-call").alias("tag"), F.lit("ship").alias("method"), F.lit("r").alias("recv"), F.concat("func", F.lit(":1")).alias("pos"))
    empty = t.spark.createDataFrame([], _INS)
    return empty.unionByName(own, True).unionByName(phi, True).unionByName(call, True)


@query(f"WITH {_OPEN} SELECT 'O' || l_orderkey AS func, CASE WHEN bool_or(l_linestatus <> 'O') THEN 'widened' ELSE 'narrow' END AS confidence, coalesce(array_to_string(list_sort(list_distinct(list(p_type) FILTER (l_linestatus = 'O'))), ','), '') AS types, CASE WHEN bool_or(l_linestatus <> 'O') THEN 'parameter' ELSE '' END AS reasons FROM op GROUP BY l_orderkey")
def narrow_values(t):
    ins = checkpointed(_program(t))
    facts = V.narrow_facts(ins, t.spark.createDataFrame([], "func string, val string"), t.spark.createDataFrame([], "iface string, type string"))
    out = V.narrow_values(*facts).where(F.col("node").endswith("::r"))
    return out.select(F.substring_index("node", "::", 1).alias("func"), "confidence", joined("types"), joined("reasons"))


@query(f"WITH {_OPEN} SELECT DISTINCT 'O' || l_orderkey AS src, p_type || '.ship' AS dst, 'O' || l_orderkey || ':1' AS pos FROM op WHERE l_linestatus = 'O'")
def vta_calls(t):
    ins = checkpointed(_program(t))
    copies = ins.where("tag = 'ssa-phi'").select("func", F.explode("operands").alias("o"), "name").select(V.value("func", "o").alias("src"), V.value("func", "name").alias("dst"))
    return V.vta_calls(ins, copies)


@query(
    """WITH sl AS (SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(l_suppkey) AS one FROM lineitem GROUP BY 1, 2)
SELECT DISTINCT 'O' || l.l_orderkey AS src, 'S' || l.l_suppkey AS dst, 'O' || l.l_orderkey || ':' || l.l_linenumber AS pos FROM lineitem l JOIN sl USING (l_orderkey, l_linenumber) JOIN orders ON o_orderkey = l.l_orderkey WHERE (n = 1 AND o_orderstatus <> 'P') OR l.l_suppkey % 2 = 0"""
)
def precise_calls(t):
    """Slots of an order's table hold its suppliers; where a slot is stored to twice or the order is partial, the wider graph decides, which knows even suppliers."""
    line = t.lineitem.select(_id("O", "l_orderkey").alias("func"), F.col("l_linenumber").cast("string").alias("field"), _id("S", "l_suppkey").alias("callee"), "l_suppkey")
    pos = F.concat_ws(":", "func", "field")
    stores = line.select("func", F.lit("ssa-store").alias("tag"), F.lit("t").alias("addr"), "field", "callee")
    calls = line.select("func", "field").distinct().select("func", F.lit("ssa-call").alias("tag"), F.lit("t").alias("addr"), "field", pos.alias("pos"))
    gone = t.orders.where("o_orderstatus = 'P'").select(_id("O", "o_orderkey").alias("func"), F.lit("ssa-escape").alias("tag"), F.lit("t").alias("addr"))
    ins = t.spark.createDataFrame([], _INS).unionByName(stores, True).unionByName(calls, True).unionByName(gone, True)
    rest = line.where("l_suppkey % 2 = 0").select(F.col("func").alias("src"), F.col("callee").alias("dst"), pos.alias("pos"))
    return V.precise_calls(checkpointed(ins), rest).distinct()


_FORM = "fm AS (SELECT l_orderkey, string_agg(least(l_returnflag, l_linestatus) || greatest(l_returnflag, l_linestatus), ';' ORDER BY l_linenumber, least(l_returnflag, l_linestatus) || greatest(l_returnflag, l_linestatus)) AS form FROM lineitem GROUP BY 1), nx AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)"


@query(f"WITH {_FORM} SELECT a, b, coalesce(x.form = y.form, false) AS equivalent FROM nx LEFT JOIN fm x ON x.l_orderkey = a LEFT JOIN fm y ON y.l_orderkey = b WHERE b IS NOT NULL")
def ssa_equivalent(t):
    """Consecutive orders whose lines add the same flags, in whatever order of operands."""
    f = D.normalize(F.lit("+"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(False))
    forms = t.lineitem.select(F.col("l_orderkey").alias("func"), F.lit(0).alias("block"), F.col("l_linenumber").alias("ord"), F.concat(f["x"], f["y"]).alias("form"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = t.orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b IS NOT NULL")
    return V.equivalent(pairs, forms)


@query("SELECT 'C' || c_custkey AS a, 'P' || p_partkey AS b, EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_partkey = p_partkey) AS creates_cycle FROM customer JOIN part ON c_custkey = p_partkey")
def creates_cycle(t):
    """Whether a customer comes to the part of the same number."""
    pairs = t.customer.join(t.part, F.col("c_custkey") == F.col("p_partkey")).select(_id("C", "c_custkey").alias("a"), _id("P", "p_partkey").alias("b"))
    d = hierarchy(t).where(F.substring("src", 1, 1).isin("C", "O"))
    return C.creates_cycle(pairs, checkpointed(d))


@query(f"{_K}, dp AS (SELECT mask, 0 AS depth FROM c UNION SELECT b.mask, depth + 1 FROM dp a JOIN c b ON a.mask <> b.mask AND b.mask & a.mask = a.mask) SELECT array_to_string(intent, ',') AS intent, CAST(max(depth) AS BIGINT) AS depth FROM dp JOIN c USING (mask) GROUP BY ALL")
def lattice_depth(t):
    return C.depths(_lattice(t)).withColumn("intent", joined("intent"))


@query(
    f"""{_K}, xy AS (SELECT x.intent AS a, y.intent AS b, x.mask & y.mask AS lo, x.mask | y.mask AS hi FROM c x, c y), mt AS (SELECT a, b, lo, arg_min(z.intent, z.n_attrs) AS meet FROM xy JOIN c z ON z.mask & hi = hi GROUP BY a, b, lo)
SELECT array_to_string(a, ',') AS a, array_to_string(b, ',') AS b, array_to_string(c.intent, ',') AS join_intent, array_to_string(meet, ',') AS meet_intent FROM mt JOIN c ON c.mask = lo"""
)
def lattice_algebra(t):
    m = C.meets(_lattice(t))
    return m.select(joined("a"), joined("b"), joined("join_intent"), joined("meet_intent"))


@query(f"{_K} SELECT object, array_to_string(list_sort(list(array_to_string(intent, ','))), ';') AS intents FROM (SELECT unnest(extent) AS object, intent FROM c) GROUP BY object")
def concept_signature(t):
    return C.signature(_lattice(t)).select("object", F.array_join("intents", ";").alias("intents"))


# trees: consecutive orders of a customer, as trees of fields and lists of lines

_LINE = "(SELECT *, 'order/lines/' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity) - 1) AS spot FROM lineitem)"
_LEAF = f"""li AS MATERIALIZED {_LINE},
lf AS MATERIALIZED (SELECT o_orderkey AS tree, 'order' AS path, '' AS field, 'node' AS vtype, 'order' AS value FROM orders
 UNION ALL SELECT o_orderkey, 'order/type', 'type', 'string', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'order/signature', 'signature', 'string', 'to ' || o_orderstatus FROM orders
 UNION ALL SELECT o_orderkey, 'order/name', 'name', 'string', o_orderpriority FROM orders
 UNION ALL SELECT l_orderkey, spot, 'line', 'node', 'line-' || l_linestatus FROM li UNION ALL SELECT l_orderkey, spot || '/tok', 'tok', 'string', l_returnflag FROM li
 UNION ALL SELECT l_orderkey, spot || '/value', 'value', 'int', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM li),
pr AS MATERIALIZED (SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL),
ll AS MATERIALIZED (SELECT a, b, path, field, vtype, value FROM pr JOIN lf ON tree = a), rr AS MATERIALIZED (SELECT a, b, path, field, vtype, value FROM pr JOIN lf ON tree = b),
d0 AS MATERIALIZED (SELECT coalesce(ll.a, rr.a) AS a, coalesce(ll.b, rr.b) AS b, coalesce(ll.path, rr.path) AS path, coalesce(ll.vtype, rr.vtype) AS vtype, CASE WHEN rr.path IS NULL OR ll.path IS NULL THEN 'extra-element' WHEN ll.value = rr.value THEN 'shared' WHEN ll.vtype = 'node' THEN 'structural'
  ELSE CASE ll.field WHEN 'tok' THEN 'operator' WHEN 'type' THEN 'type-name' WHEN 'signature' THEN 'type-name' WHEN 'value' THEN 'literal-value' ELSE 'identifier' END END AS category, ll.value AS "left", rr.value AS "right" FROM ll FULL JOIN rr ON ll.a = rr.a AND ll.b = rr.b AND ll.path = rr.path),
st AS MATERIALIZED (SELECT a, b, path FROM d0 WHERE vtype = 'node' AND category <> 'shared'),
df AS MATERIALIZED (SELECT d0.a, d0.b, d0.path, d0.category, "left", "right" FROM d0 LEFT JOIN st ON st.a = d0.a AND st.b = d0.b AND d0.path IN (st.path || '/tok', st.path || '/value') WHERE st.a IS NULL)"""


def _diffs(t: Tables) -> DataFrame:
    o = t.orders
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")) - 1
    line = line.withColumn("at", F.concat(F.lit("order/lines/"), rn.cast("string")))
    row = lambda path, field, vtype, value: F.struct(path.alias("path"), F.lit(field).alias("field"), F.lit(vtype).alias("vtype"), value.alias("value"))
    head = F.array(row(F.lit("order"), "", "node", F.lit("order")), row(F.lit("order/type"), "type", "string", F.col("o_orderstatus")), row(F.lit("order/signature"), "signature", "string", F.concat(F.lit("to "), F.col("o_orderstatus"))), row(F.lit("order/name"), "name", "string", F.col("o_orderpriority")))
    body = F.array(row(F.col("at"), "line", "node", F.concat(F.lit("line-"), F.col("l_linestatus"))), row(F.concat("at", F.lit("/tok")), "tok", "string", F.col("l_returnflag")), row(F.concat("at", F.lit("/value")), "value", "int", F.col("l_quantity").cast("long").cast("string")))
    leaves = o.select(F.col("o_orderkey").alias("tree"), F.explode(head).alias("x")).union(line.select("l_orderkey", F.explode(body))).select("tree", "x.*")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = o.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b IS NOT NULL")
    return T.tree_diff(pairs, leaves, T.classify_ast)


@query(f"WITH {_LEAF} SELECT * FROM df WHERE category <> 'shared'")
def tree_diff(t):
    return _diffs(t).where("category <> 'shared'")


# the signature's letter always follows from the type's
_SCORE = f"""WITH {_LEAF}, sc AS (SELECT a, b, count(*) FILTER (category = 'shared') AS shared, count(*) FILTER (category <> 'shared') AS diff_count, count(*) FILTER (category = 'type-name' AND path = 'order/signature') AS derived, count(*) FILTER (category = 'literal-value') AS value_params,
count(DISTINCT "left") FILTER (category = 'type-name' AND path = 'order/type') AS type_params, CAST(sum(CASE category WHEN 'type-name' THEN (CASE path WHEN 'order/type' THEN 1 ELSE 0 END) WHEN 'literal-value' THEN 1 WHEN 'operator' THEN 2 WHEN 'structural' THEN 100 WHEN 'extra-element' THEN 50 ELSE 0 END) AS BIGINT) AS cost FROM df GROUP BY a, b)"""


@query(f"{_SCORE} SELECT a, b, shared, diff_count, derived, value_params, type_params, cost, round(CAST(shared AS DOUBLE) / (shared + diff_count), 6) AS similarity, round(CAST(shared + derived AS DOUBLE) / (shared + diff_count), 6) AS effective FROM sc")
def score_diffs(t):
    return T.score(_diffs(t)).select("a", "b", "shared", "diff_count", "derived", "value_params", "type_params", "cost", "similarity", "effective")


_PART = """nx AS MATERIALIZED (SELECT *, lead(p_partkey) OVER w AS b, lead(p_name) OVER w AS name2, lead(p_type) OVER w AS type2 FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey))"""


def _parts(t: Tables) -> DataFrame:
    """Diffs of the parts of a brand and size that follow each other, as trees of their fields."""
    row = lambda path, field, vtype, value: F.struct(F.lit(path).alias("path"), F.lit(field).alias("field"), F.lit(vtype).alias("vtype"), value.cast("string").alias("value"))
    leaves = t.part.select(F.col("p_partkey").alias("tree"), F.explode(F.array(row("part", "", "node", F.lit("part")), row("part/name", "name", "string", F.col("p_name")), row("part/type", "type", "string", F.col("p_type")), row("part/label", "label", "string", F.col("p_brand")), row("part/value", "value", "int", F.col("p_size")))).alias("x")).select("tree", "x.*")
    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    pairs = t.part.select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b")).where("b IS NOT NULL")
    return T.tree_diff(pairs, leaves, T.classify_ast)


@query(f"WITH {_PART} SELECT p_partkey AS a, b, CAST((CASE WHEN p_name = name2 THEN 1 ELSE 0 END) + (CASE WHEN p_type = type2 THEN 1 ELSE 0 END) + 3 AS BIGINT) AS shared FROM nx WHERE b IS NOT NULL")
def unifiable(t):
    return T.unifiable(T.score(_parts(t))).where("unifiable").select("a", "b", "shared")


@query(f"WITH {_PART} SELECT p_partkey AS a, b, path, text FROM (SELECT *, unnest(['part', 'part/name', 'part/type', 'part/label', 'part/value']) AS path, unnest(['part', p_name, CASE WHEN p_type = type2 THEN p_type ELSE '?T0' END, p_brand, CAST(p_size AS VARCHAR)]) AS text FROM nx WHERE b IS NOT NULL)")
def unify_template(t):
    """What two parts have in common, with their types as a parameter."""
    return T.template(T.collapse(_parts(t))).select("a", "b", "path", "text")


_FOLD = "list_reduce(list_prepend({'l': p.l, 'r': ''}, roots), lambda s, q: {'l': replace(s.l, q.l, q.r), 'r': ''}).l"


@query(
    f"""WITH RECURSIVE pp AS (SELECT DISTINCT p_brand, p_name AS l, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part), po AS MATERIALIZED (SELECT p_brand, {{'l': l, 'r': r}} AS p, row_number() OVER (PARTITION BY p_brand ORDER BY length(l), l, r) AS i FROM pp WHERE r IS NOT NULL AND l <> r),
rs AS (SELECT DISTINCT p_brand, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS roots FROM po UNION ALL SELECT rs.p_brand, po.i, CASE WHEN {_FOLD} = p.r THEN roots ELSE list_append(roots, p) END FROM rs JOIN po ON po.p_brand = rs.p_brand AND po.i = rs.i + 1)
SELECT p_brand, CAST(len(roots) AS INTEGER) AS roots FROM (SELECT p_brand, arg_max(roots, i) AS roots FROM rs GROUP BY p_brand)"""
)
def root_substitution(t):
    """Root substitutions between the names of neighbouring parts, by brand."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = t.part.select("p_brand", F.col("p_name").alias("left"), F.lead("p_name").over(w).alias("right")).where("right IS NOT NULL AND left <> right")
    g = p.groupBy("p_brand").agg(F.collect_set(F.struct("left", "right")).alias("p"))
    return g.select("p_brand", F.size(T.root_substitutions(F.col("p"))).alias("roots"))


# duplicates: orders of the same parts

_DUP = f"""WITH {REFERENCES}, ks AS MATERIALIZED (SELECT func AS item, list_sort(list(name)) AS keys FROM r GROUP BY func), fs AS MATERIALIZED (SELECT item, keys, min(item) OVER (PARTITION BY keys) AS first FROM ks),
rp AS MATERIALIZED (SELECT item, keys, unnest(keys) AS key FROM fs WHERE item = first), pp AS MATERIALIZED (SELECT x.item AS a, y.item AS b, count(*) AS cm, any_value(len(x.keys) + len(y.keys)) AS n FROM rp x JOIN rp y ON x.key = y.key AND x.item < y.item GROUP BY 1, 2),
sv AS (SELECT first AS a, item AS b, 1.0::DOUBLE AS similarity, 'proven' AS tier FROM fs WHERE item <> first UNION ALL SELECT a, b, round(CAST(cm AS DOUBLE) / (n - cm), 6), CASE WHEN CAST(cm AS DOUBLE) / (n - cm) >= 0.6 THEN 'structural' ELSE 'divergent' END FROM pp WHERE cm * 5 >= (n - cm) * 2)"""


def _duplicates(t: Tables) -> DataFrame:
    s = C.similar_sets(references(t).select(F.col("func").alias("item"), F.col("name").alias("key")))
    return s.select("a", "b", F.round("similarity", 6).alias("similarity"), C.tier(F.col("same"), F.col("similarity")).alias("tier"))


@query(f"{_DUP} SELECT a, b, similarity, tier FROM sv")
def dup_scored(t):
    return _duplicates(t)


@query(f"{_DUP} SELECT a, b, CASE tier WHEN 'proven' THEN 'duplicate' WHEN 'structural' THEN 'likely-duplicate' ELSE 'distinct' END AS verdict FROM sv")
def dup_verdict(t):
    return _duplicates(t).select("a", "b", C.verdict("tier").alias("verdict"))


@query(f"{_DUP}, cs AS MATERIALIZED (SELECT l_orderkey AS item, list_distinct(list(l_suppkey)) AS callers, any_value(o_custkey) AS cust FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey) SELECT a, b, CASE WHEN ca.cust = cb.cust THEN 'same-pkg' WHEN len(list_intersect(ca.callers, cb.callers)) > 0 THEN 'shared-callers' ELSE 'disjoint' END AS locality, CAST(len(list_distinct(list_concat(ca.callers, cb.callers))) AS INTEGER) AS new_edges FROM sv JOIN cs ca ON ca.item = a JOIN cs cb ON cb.item = b WHERE tier <> 'divergent'")
def dup_cost(t):
    p = _duplicates(t).where("tier <> 'divergent'").select("a", "b")
    cs = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_suppkey").alias("callers")).join(t.orders.select(F.col("o_orderkey").alias("item"), "o_custkey"), "item")
    side = lambda x: cs.select(F.col("item").alias(x), F.col("callers").alias(f"c{x}"), F.col("o_custkey").alias(f"n{x}"))
    j = p.join(side("a"), "a").join(side("b"), "b")
    return j.select("a", "b", C.locality(F.col("na") == F.col("nb"), "ca", "cb").alias("locality"), C.new_edges("ca", "cb").alias("new_edges"))


_NORM = "dd AS (SELECT doc_id, md5(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS h FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_NORM} SELECT min(doc_id) AS first_doc, count(*) AS size FROM dd GROUP BY h HAVING count(*) > 1")
def dup_clusters(t):
    """Documents that differ in case and white space only; texts are hashed before they are grouped."""
    h = F.md5(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return t.documents.where("text IS NOT NULL").select("doc_id", h.alias("h")).groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("size")).where("size > 1").select("first_doc", "size")


# domains


# each part as a function: x starts with its size, and a loop adds a step that its type gives and doubles y
_LOOP = "lp AS (SELECT p_partkey AS func, CAST(p_size AS DOUBLE) AS size, CASE p_type WHEN 'SMALL' THEN -1 WHEN 'MEDIUM' THEN 0 ELSE 2 END AS step FROM part)"


def _loops(t: Tables) -> tuple[DataFrame, DataFrame]:
    step = F.when(F.col("p_type") == "SMALL", "-1:int").when(F.col("p_type") == "MEDIUM", "0:int").otherwise("2:int")
    row = lambda block, ord_, name, op, x, y: F.struct(F.lit(block).alias("block"), F.lit(ord_).alias("ord"), F.lit(name).alias("name"), F.lit(op).alias("op"), x.alias("x"), y.alias("y"))
    lit = F.lit
    code = F.array(
        row(0, 0, "x0", "+", F.concat(F.col("p_size").cast("string"), lit(":int")), lit("0:int")),
        row(1, 0, "x1", "phi", lit("x0"), lit("x2")),
        row(2, 0, "x2", "+", lit("x1"), step),
        row(3, 0, "y", "*", lit("x1"), lit("2:int")),
    )
    ins = t.part.select(F.col("p_partkey").alias("func"), F.explode(code).alias("i")).select("func", "i.*")
    edge = F.array(*[F.struct(lit(a).alias("src"), lit(b).alias("dst")) for a, b in ((0, 1), (1, 2), (2, 1), (1, 3))])
    return ins, t.part.select(F.col("p_partkey").alias("func"), F.explode(edge).alias("e")).select("func", "e.*")


@query(f"WITH {_LOOP} SELECT func, unnest(['x0', 'x1', 'x2', 'y']) AS name, unnest(CASE WHEN step = 0 THEN ['pos', 'pos', 'pos', 'pos'] WHEN step > 0 THEN ['pos', 'pos', 'pos', 'pos'] ELSE ['pos', 'top', 'top', 'top'] END) AS sign FROM lp")
def sign_analysis(t):
    return K.signs(*_loops(t))


@query(
    f"""WITH {_LOOP}, w AS (SELECT func, size, CASE WHEN step < 0 THEN '-Infinity'::DOUBLE ELSE size END AS lo, CASE WHEN step > 0 THEN 'Infinity'::DOUBLE ELSE size END AS hi, CASE WHEN step > 0 THEN 2 ELSE 0 END AS first, CASE WHEN step < 0 THEN -1 ELSE 0 END AS last FROM lp)
SELECT func, unnest(['x0', 'x1', 'x2', 'y']) AS name, unnest([size, lo, lo + first, 2 * lo]) AS lo, unnest([size, hi, hi + last, 2 * hi]) AS hi FROM w"""
)
def interval_analysis(t):
    """Bounds that the loop moves are widened."""
    return K.intervals(*_loops(t))


@query(f"WITH {_LOOP} SELECT func, unnest(['x0', 'x1', 'x2', 'y']) AS name, unnest(CASE WHEN step = 0 THEN [CAST(CAST(size AS BIGINT) AS VARCHAR), CAST(CAST(size AS BIGINT) AS VARCHAR), CAST(CAST(size AS BIGINT) AS VARCHAR), CAST(CAST(size * 2 AS BIGINT) AS VARCHAR)] ELSE [CAST(CAST(size AS BIGINT) AS VARCHAR), 'top', 'top', 'top'] END) AS value FROM lp")
def const_loops(t):
    return K.constants(*_loops(t))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 5 WHEN 0 THEN q + n WHEN 1 THEN q - n WHEN 2 THEN q * n WHEN 3 THEN q // n ELSE q % n END AS value FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)")
def const_prop(t):
    op = F.element_at(F.array(*map(F.lit, "+-*/%")), (F.col("l_linenumber") % 5 + 1).cast("int"))
    x = D.constant(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(":int")))
    y = D.constant(F.concat(F.col("l_linenumber").cast("string"), F.lit(":int64")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.fold(op, x, y).alias("value"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 1 THEN '*' ELSE '-' END AS op, CAST(CAST(l_quantity AS BIGINT) % 3 AS VARCHAR) AS x, CAST(l_linenumber % 2 AS VARCHAR) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN op = '+' AND y = '0' THEN 'copy ' || x WHEN op = '+' AND x = '0' THEN 'copy ' || y WHEN op = '*' AND y = '1' THEN 'copy ' || x WHEN op = '*' AND x = '1' THEN 'copy ' || y WHEN op = '*' AND (x = '0' OR y = '0') THEN 'const 0' WHEN op IN ('+', '*') THEN op || ' ' || least(x, y) || ' ' || greatest(x, y) ELSE op || ' ' || x || ' ' || y END AS form FROM b"""
)
def ssa_normalize(t):
    op = F.when(F.col("l_linenumber") % 3 == 0, "+").when(F.col("l_linenumber") % 3 == 1, "*").otherwise("-")
    f = D.normalize(op, (F.col("l_quantity").cast("long") % 3).cast("string"), (F.col("l_linenumber") % 2).cast("string"), F.lit(True))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(" ", f["op"], f["x"], f["y"]).alias("form"))


# findings


def _findings(t: Tables) -> DataFrame:
    s = order_sites(t)
    d = B.deviations(s, B.verdict(B.votes(s)))
    return d.select(N.finding(F.col("category"), F.concat(F.lit("orders:"), F.col("site").cast("string")), "deviates", {"pattern": F.col("pattern"), "category": F.col("category")}, F.lit(0.5)).alias("f"), "category")


@query(f"WITH {SITES}, {VERDICT} SELECT 'orders:' || site || ' — deviates (category=' || category || ', pattern=' || pattern || ') [0.50]' AS line FROM s, m WHERE category <> pattern")
def findings_render(t):
    return _findings(t).select(N.render(F.col("f")).alias("line"))


@query(f"WITH {SITES}, {VERDICT}, li AS (SELECT category, 'orders:' || site || ' — deviates (category=' || category || ', pattern=' || pattern || ') [0.50]' AS line FROM s, m WHERE category <> pattern) SELECT category, true AS header, upper(category) || ' (' || count(*) || ')' AS text FROM li GROUP BY category UNION ALL SELECT category, false, line FROM li")
def findings_by_category(t):
    return N.render_category(_findings(t).select("category", N.render(F.col("f")).alias("line")), "category", "line")


@query(f"WITH {SITES}, {VERDICT} SELECT '{{\"provenance\": {{\"query\": \"belief_votes\"}}, \"version\": \"0.1.0\", \"result\": {{\"category\":\"' || category || '\",\"cnt\":' || cnt || ',\"first_site\":' || first_site || '}}}}' AS line FROM v")
def envelope_json(t):
    return N.envelope_json(B.votes(order_sites(t)), {"query": "belief_votes"})


@query("SELECT date_trunc('day', ts) AS day, event_type AS category, count(*) AS cnt FROM events GROUP BY ALL")
def windowed_votes(t):
    from ..streaming.beliefs import windowed_votes as votes

    return votes(t.events, F.col("event_type")).select(F.col("window.start").alias("day"), "category", "cnt")
