"""Fact tables: schemas, loading from Parquet or JSON, and lazily derived relations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import paths

SCHEMAS = {
    "node": "tree string, id long, parent long, path array<string>, ord int, tag string, field string, vtype string, value string",
    "func": "func string, short_name string, pkg string, file string, pos string, recv_type string, is_method boolean, signature string, n_params int, n_results int, n_stmts int",
    "param": "func string, ord int, name string, type string",
    "block": "func string, idx int, idom int, preds array<int>, succs array<int>, comment string, recover boolean",
    "instr": "func string, block int, ord int, tag string, name string, op string, x string, y string, addr string, val string, callee string, method string, recv string, type string, concrete string, struct string, field string, operands array<string>, pos string",
    "call_ast": "func string, ord int, callee string, is_defer boolean",
    "cg_node": "name string, id long, pkg string",
    "cg_edge": "edge_id long, algo string, caller string, callee string, pos string, description string, caller_synthetic boolean, iface string, method string, recv string",
    "field_access": "func string, pkg string, pos string, struct string, struct_pkg string, field string, recv string, mode string",
    "func_ref": "func string, pkg string, pos string, ref_pkg string, object string",
    "iface_method": "iface string, pkg string, method string",
    "implements": "iface string, type string, type_pkg string",
    "method": "type string, method string",
    "diagnostic": "analyzer string, pos string, message string, category string",
}


class FactCatalog:
    """Facts under one folder, ``<table>.parquet`` or ``<table>.json``; corrupt JSON fails at once."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self.tables = spark, folder, dict(tables or {})

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            if name not in SCHEMAS:
                raise KeyError(f"no fact table {name}")
            if self.folder is None:
                return self.spark.createDataFrame([], SCHEMAS[name])
            reader = self.spark.read.schema(SCHEMAS[name])
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            self.tables[name] = reader.json(f"{self.folder}/{name}.json", mode="FAILFAST") if there else reader.parquet(f"{self.folder}/{name}.parquet")
        return self.tables[name]

    @cached_property
    def functions(self) -> DataFrame:
        return self.table("func").withColumn("short_name", F.coalesce("short_name", F.substring_index("func", ".", -1)))

    def callgraph(self, *algorithms: str) -> DataFrame:
        """Edges of the first algorithm that has any."""
        rank = F.coalesce(*[F.when(F.col("algo") == a, i) for i, a in enumerate(algorithms)])
        e = self.table("cg_edge").withColumn("rank", rank).where("rank IS NOT NULL")
        best = e.agg(F.min("rank").alias("least"))
        return e.join(F.broadcast(best), F.col("rank") == F.col("least")).drop("rank", "least")

    def views(self, prefix: str = "") -> list[str]:
        """Temporary views of all fact tables for SQL, by the names given back."""
        names = []
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    def save(self, folder: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def field_index(instructions: DataFrame) -> DataFrame:
    """(func, struct, field, mode): an address of a field is written if something stores to it, else read; direct reads are read."""
    stores = instructions.where("tag = 'ssa-store'").select("func", F.col("addr").alias("name")).distinct().withColumn("w", F.lit(True))
    addr = instructions.where("tag = 'ssa-field-addr'").join(stores, ["func", "name"], "left").select("func", "struct", "field", F.when(F.col("w"), "write").otherwise("read").alias("mode"))
    return addr.unionByName(instructions.where("tag = 'ssa-field'").select("func", "struct", "field", F.lit("read").alias("mode")))


def implementors(methods: DataFrame, interfaces: DataFrame, name: str) -> DataFrame:
    """(type) with all methods of the one interface called ``name`` (short or qualified); ambiguous, unknown or empty ones raise."""
    full = F.concat_ws(".", "pkg", "iface")
    own = interfaces.where((F.col("iface") == name) | (full == name))
    keys = [r[0] for r in own.select(full).distinct().limit(20).collect()]
    if len(keys) != 1:
        raise ValueError(f"{name} is {'ambiguous: ' + ', '.join(sorted(keys)) if keys else 'unknown'}")
    want = own.where("method IS NOT NULL").select("method").distinct()
    n = want.count()
    if n == 0:
        raise ValueError(f"{name} has no methods")
    return methods.join(want, "method", "left_semi").groupBy("type").agg(F.countDistinct("method").alias("n")).where(F.col("n") == n).select("type")


def function_refs(uses: DataFrame) -> DataFrame:
    """(func, ref_pkg, objects) of uses (func, pkg, obj_pkg, object) across packages."""
    return uses.where("obj_pkg IS NOT NULL AND obj_pkg <> pkg").groupBy("func", F.col("obj_pkg").alias("ref_pkg")).agg(F.sort_array(F.collect_set("object")).alias("objects"))


def static_calls(instructions: DataFrame) -> DataFrame:
    return instructions.where("tag = 'ssa-call' AND callee IS NOT NULL").select(F.col("func").alias("src"), F.col("callee").alias("dst"), "pos")


def cha_calls(instructions: DataFrame, implements: DataFrame) -> DataFrame:
    """Calls of an interface method go to that method of every implementor."""
    calls = instructions.where("method IS NOT NULL").select("func", "recv", "method", "pos")
    return calls.join(implements, calls.recv == implements.iface).select(F.col("func").alias("src"), F.concat_ws(".", "type", "method").alias("dst"), "pos")


def rta_calls(static: DataFrame, cha: DataFrame, creates: DataFrame, roots: DataFrame) -> DataFrame:
    """CHA edges to types that functions reachable from the roots create (func, type), with the static ones."""
    from ..plans.fixpoint import checkpointed

    typed = cha.withColumn("type", F.substring_index("dst", ".", 1))
    edges = checkpointed(static.select("src", "dst").distinct())
    while True:
        seen = paths.reachable(edges, roots).select(F.col("node").alias("func")).union(roots.select("node")).distinct()
        live = creates.join(seen, "func", "left_semi").select("type").distinct()
        new = checkpointed(static.select("src", "dst").union(typed.join(live, "type", "left_semi").select("src", "dst")).distinct())
        if new.count() == edges.count():
            return new
        edges = new


def canonical_names(instructions: DataFrame) -> DataFrame:
    """Instructions with registers renamed r0, r1, ... in order of block and position."""
    w = Window.partitionBy("func").orderBy("block", "ord")
    names = instructions.where("name IS NOT NULL").select("func", "name", F.concat(F.lit("r"), (F.row_number().over(w) - 1).cast("string")).alias("canonical"))
    m = names.groupBy("func").agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("m"))
    t = instructions.join(m, "func", "left")
    new = lambda c: F.coalesce(F.try_element_at("m", c), c)
    return t.withColumn("name", new(F.col("name"))).withColumn("operands", F.transform("operands", new)).drop("m")
