"""Archives of solved models: parquet tables of sources and answers under one run, readable together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.api import Model, Result
from rowloom.errors import LayoutError
from rowloom.sources import door

FORMAT = 1
RUN = "run_id"


def save(model: Model, result: Result, path: str, run: str | None = None) -> str:
    """Write sources, answer and catalog of a run under `path`/<run>; returns the run's id.

    The catalog comes last, so a folder without one is an unfinished write.
    """
    spark, run = model.spark, run or uuid.uuid4().hex
    root = f"{path}/{RUN}={run}"
    for name, table in door.tidy(model.handoff.attached).items():
        table.write.parquet(f"{root}/sources/{name}")
    entries = []
    if result.answer.x is not None:
        for name in model.program.variables:
            result.primal(name).write.parquet(f"{root}/answer/primal/{name}")
            entries.append(("primal", name))
        for name in model.program.constraints if result.answer.y is not None else ():
            result.dual(name).write.parquet(f"{root}/answer/dual/{name}")
            entries.append(("dual", name))
        for name in model.program.expressions:
            result.evaluate(name).write.parquet(f"{root}/answer/expression/{name}")
            entries.append(("expression", name))
    rows = [(FORMAT, k, n, result.status, result.termination_condition, result.answer.objective, json.dumps(model.spec, default=str)) for k, n in entries or [("none", "")]]
    spark.createDataFrame(rows, "format int, kind string, name string, status string, termination_condition string, objective double, spec string").write.parquet(f"{root}/catalog")
    return run


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, kind, name, status, termination_condition, objective, spec) of every finished run under a path."""
    found = spark.read.option("basePath", path).parquet(f"{path}/{RUN}=*/catalog")
    beyond = found.filter(F.col("format") > FORMAT).limit(1).collect()
    if beyond:
        raise LayoutError(f"run {beyond[0][RUN]} was written in a later format")
    return found.select(F.col(RUN).cast("string").alias(RUN), *[c for c in found.columns if c not in (RUN, "format")])


def scan(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    """One answer table over all runs, by name of column; runs that lack a column have nulls there."""
    runs = catalog(spark, path).filter((F.col("kind") == kind) & (F.col("name") == name)).select(RUN)
    table = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(f"{path}/{RUN}=*/answer/{kind}/{name}")
    return table.withColumn(RUN, F.col(RUN).cast("string")).join(runs, RUN, "left_semi")


def inputs(spark: SparkSession, path: str, run: str) -> tuple[dict, dict[str, DataFrame]]:
    """The specification and the sources of a run, ready to build again."""
    spec = json.loads(catalog(spark, path).filter(F.col(RUN) == run).select("spec").first()[0])
    names = [n for s in ("dimensions", "relations", "parameters") for n in (spec.get(s) or {})]
    return spec, {n: spark.read.parquet(f"{path}/{RUN}={run}/sources/{n}") for n in names}


def union_runs(tables: dict[str, DataFrame], run: str = RUN) -> DataFrame:
    """Tables of several runs under one another, each with its run's name; missing columns are null."""
    out = None
    for k, t in tables.items():
        part = t.withColumn(run, F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
