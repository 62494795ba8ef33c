"""Located findings: value, where, why, score; rendering; envelopes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__


def finding(value: Column, where: Column, tag: str, data: dict[str, Column], score: Column | None = None) -> Column:
    why = F.struct(F.lit(tag).alias("tag"), F.create_map(*[x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]).alias("data"))
    return F.struct(value.cast("string").alias("value"), where.cast("string").alias("where"), why.alias("why"), (F.lit(None) if score is None else score).cast("double").alias("score"))


def render_why(f: Column) -> Column:
    """``tag (k=v, ...)``, keys in order."""
    entries = F.array_sort(F.map_entries(f["why"]["data"]))
    inner = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ", ")
    return F.when(F.size(entries) == 0, f["why"]["tag"]).otherwise(F.concat(f["why"]["tag"], F.lit(" ("), inner, F.lit(")")))


def render(f: Column) -> Column:
    """``where - why [score]``; NULL places are ``<unlocated>``."""
    text = F.concat(F.coalesce(f["where"], F.lit("<unlocated>")), F.lit(" — "), render_why(f))
    return F.when(f["score"].isNull(), text).otherwise(F.concat(text, F.lit(" ["), f["score"].cast("decimal(20,2)").cast("string"), F.lit("]")))


def render_category(rows: DataFrame, label: str, line: str) -> DataFrame:
    """(label, header, text): a header ``LABEL (N)`` for each label and its lines, a row each."""
    heads = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(label, F.lit(True).alias("header"), F.concat(F.upper(label), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text"))
    return heads.unionByName(rows.select(label, F.lit(False).alias("header"), F.col(line).alias("text")))


def first_position(instructions: DataFrame, where: Column) -> DataFrame:
    """(func, pos): place of the first matching instruction (func, block, ord, pos) that has one."""
    return instructions.where(where & F.col("pos").isNotNull()).groupBy("func").agg(F.min_by("pos", F.struct("block", "ord")).alias("pos"))


def envelope(result: DataFrame, provenance: dict) -> dict:
    return {"version": __version__, "provenance": provenance, "result": result}


def envelope_json(result: DataFrame, provenance: dict) -> DataFrame:
    """(line): one JSON object for each row, with version and provenance."""
    head = json.dumps({"version": __version__, "provenance": provenance}, sort_keys=True)[:-1]
    return result.select(F.concat(F.lit(head + ', "result": '), F.to_json(F.struct(*result.columns)), F.lit("}")).alias("line"))
