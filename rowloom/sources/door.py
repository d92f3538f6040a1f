"""The door: tables as given become checked DataFrames, one per declaration.

Dimension:  (<name>, ord)       ord counts the labels from 0, in the order given
Parameter:  (<dims>..., value)  one row per coordinate
Relation:   (<columns>...)
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import DataError
from rowloom.plans.spec import Parameter, Program

LABEL = {"int": "bigint", "float": "double", "str": "string", "datetime": "timestamp_ntz"}
VALUE = {"float": "double", "int": "bigint", "bool": "boolean", "str": "string"}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Dimension tables of at most so many bytes are broadcast; larger ones are left to the optimiser.
BROADCAST_BYTES = 64 << 20
#: Dimensions of at most so many labels are held on the driver; larger ones are checked, and numbered, where they are.
DRIVER_LABELS = 100_000


@dataclass
class Attached:
    """What a program's names stand for. sizes: labels of each dimension."""

    spark: SparkSession
    program: Program
    dimensions: dict[str, DataFrame] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    relations: dict[str, DataFrame] = field(default_factory=dict)
    parameters: dict[str, DataFrame] = field(default_factory=dict)
    given: dict[str, DataFrame] = field(default_factory=dict)  # coordinates given, where gaps were filled
    bytes: dict[str, int] = field(default_factory=dict)  # of each dimension's labels and positions
    finite: set[str] = field(default_factory=set)  # parameters without an infinite value

    def dimension(self, name: str) -> DataFrame:
        table = self.dimensions[name]
        return F.broadcast(table) if self.bytes[name] <= BROADCAST_BYTES else table

    def one_row(self) -> DataFrame:
        return self.spark.range(1).select()

    def product(self, dims: tuple[str, ...], ords: bool = False) -> DataFrame:
        """Every coordinate of the dimensions, with their ordinals as ord_<name> if asked."""
        out = None
        for d in dims:
            part = self.dimension(d).select(d, F.col("ord").alias(f"ord_{d}")) if ords else self.dimension(d).select(d)
            out = part if out is None else out.crossJoin(part)
        return self.one_row() if out is None else out

    def size(self, dims) -> int:
        n = 1
        for d in dims:
            n *= self.sizes[d]
        return n


def _frame(spark: SparkSession, source, columns: list[str]) -> DataFrame:
    """A table as a DataFrame: a DataFrame, a parquet path, a pandas or Arrow table, or columns."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str) or hasattr(source, "__fspath__"):
        return spark.read.parquet(str(source))
    if isinstance(source, dict) and any(c in source for c in columns):
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(source))
    if hasattr(source, "index") and hasattr(source, "to_frame") and getattr(source, "ndim", 0) == 1:
        if getattr(source.index, "nlevels", 1) > 1:
            raise DataError("a series with several index levels: give a table with named columns")
        return spark.createDataFrame(source.to_frame(columns[-1]).rename_axis(columns[0]).reset_index())
    if hasattr(source, "coords") and hasattr(source, "dims"):
        raise DataError("a labelled array: give a table with one row per coordinate, for instance its to_series().reset_index()")
    if hasattr(source, "columns") and hasattr(source, "iloc"):
        return spark.createDataFrame(source)
    if hasattr(source, "__arrow_c_stream__") or hasattr(source, "to_arrow_table"):  # Arrow, polars and DuckDB tables, whatever made them
        return spark.createDataFrame(source if isinstance(source, pa.Table) else pa.table(source) if hasattr(source, "__arrow_c_stream__") else source.to_arrow_table())
    raise DataError(f"can't read a {type(source).__name__} as a table of {', '.join(columns)}")


def _missing(df: DataFrame, columns: list[str], what: str) -> None:
    if gone := [c for c in columns if c not in df.columns]:
        raise DataError(f"{what}: no column {', '.join(gone)}; it has {', '.join(df.columns)}")


def _numbered(labels: DataFrame, name: str) -> DataFrame:
    """Labels with their place in their own order, by equal ranges: no window covers more than one range, and only counts reach the driver."""
    dealt = labels.repartitionByRange(max(2, labels.rdd.getNumPartitions()), name).select(name, F.spark_partition_id().alias("__part")).persist()
    counts = {r[0]: r[1] for r in dealt.groupBy("__part").count().collect()}
    offsets, total = [], 0
    for k in sorted(counts):
        offsets.append((k, total))
        total += counts[k]
    before = labels.sparkSession.createDataFrame(offsets, "__part int, __before bigint")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(name)) - 1
    return dealt.join(F.broadcast(before), "__part").select(name, (F.col("__before") + rank).cast("bigint").alias("ord"))


def _held(spark: SparkSession, name: str, table: pa.Table) -> tuple[DataFrame, int, int]:
    """A dimension (label, ord) that the driver has seen whole: checked without a job, and a local relation from then on."""
    labels, n = table.column(name), len(table)
    if labels.null_count or len(pc.unique(labels)) < n:
        raise DataError(f"dimension {name}: a label is null or there twice")
    order = np.sort(table.column("ord").to_numpy())
    if n and not np.array_equal(order, np.arange(n)):
        raise DataError(f"dimension {name}: ord must count the labels from 0; it runs from {order[0]} to {order[-1]} over {n} labels")
    return spark.createDataFrame(table), n, table.nbytes


def _index(spark: SparkSession, program: Program, name: str, source) -> tuple[DataFrame, int, int]:
    """(labels with ord, how many, their bytes)."""
    d = program.dimensions[name]
    if hasattr(source, "iloc") or isinstance(source, dict):
        labels = list(source[name]) if name in source else list(source.iloc[:, 0] if source.ndim > 1 else source)
        source = [x.item() if hasattr(x, "item") else str(x) if d.dtype in ("str", "datetime") else x for x in labels]
    if isinstance(source, (list, tuple, range)):
        kind = {"int": pa.int64(), "float": pa.float64()}.get(d.dtype, pa.string())
        labels = [str(x) if d.dtype == "datetime" and x is not None else x for x in source]
        try:
            column = pa.array(labels, kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError) as why:
            raise DataError(f"dimension {name}: a label isn't of type {d.dtype}: {why}") from why
        made, n, size = _held(spark, name, pa.table({name: column, "ord": pa.array(range(len(labels)), pa.int64())}))
        return made.withColumn(name, F.col(name).cast(LABEL[d.dtype])) if d.dtype == "datetime" else made, n, size
    df = _frame(spark, source, [name])
    _missing(df, [name], f"dimension {name}")
    label = F.col(name).cast(LABEL[d.dtype])
    # a DataFrame has no row order: a column ord gives it, else labels are in their own order
    table = df.select(label, F.col("ord").cast("bigint")) if "ord" in df.columns else df.select(label)
    few = table.limit(DRIVER_LABELS + 1).toArrow()
    if len(few) <= DRIVER_LABELS:
        if "ord" not in df.columns:
            few = few.sort_by(name).append_column("ord", pa.array(range(len(few)), pa.int64()))
        return _held(spark, name, few)
    if "ord" not in df.columns:
        table = _numbered(table, name)
    width = F.octet_length(F.col(name)) + 8 if d.dtype == "str" else F.lit(16)
    n, labels, orders, nulls, first, last, size = table.agg(F.count("*"), F.countDistinct(name), F.countDistinct("ord"), F.count(F.when(F.col(name).isNull(), 1)), F.min("ord"), F.max("ord"), F.coalesce(F.sum(width), F.lit(0))).first()
    if nulls or labels < n or orders < n:
        raise DataError(f"dimension {name}: a label is null or there twice")
    if (first, last) != (0, n - 1):
        raise DataError(f"dimension {name}: ord must count the labels from 0; it runs from {first} to {last} over {n} labels")
    return table, n, size


def _spread(a: Attached, p: Parameter, source) -> DataFrame | None:
    """A number, or a sequence or mapping along one dimension, spread over the parameter's dimensions."""
    if isinstance(source, (int, float, str, bool)) and not (isinstance(source, str) and (p.dtype != "str" or source.endswith(".parquet"))):
        return a.product(p.dims).select(*p.dims, F.lit(source).alias("value"))
    if isinstance(source, (list, tuple)) and len(p.dims) == 1:
        if len(source) != a.sizes[p.dims[0]]:
            raise DataError(f"parameter {p.name}: {len(source)} values for {a.sizes[p.dims[0]]} labels of {p.dims[0]}")
        return a.dimensions[p.dims[0]].join(a.spark.createDataFrame([(i, x) for i, x in enumerate(source)], ["ord", "value"]), "ord").select(p.dims[0], "value")
    if isinstance(source, dict) and len(p.dims) == 1 and p.dims[0] not in source:
        return a.spark.createDataFrame([*source.items()], [p.dims[0], "value"])
    return None


def _parameter(a: Attached, p: Parameter, source) -> DataFrame:
    df = _spread(a, p, source)
    if df is None:
        df = _frame(a.spark, source, [*p.dims, "value"])
    _missing(df, [*p.dims, "value"], f"parameter {p.name}")
    kind, allowed = df.schema["value"].dataType, {"float": (T.FloatType, T.DoubleType, T.DecimalType, *WHOLE), "int": WHOLE, "bool": (T.BooleanType,), "str": (T.StringType,)}[p.dtype]
    if not isinstance(kind, allowed):
        raise DataError(f"parameter {p.name}: {kind.simpleString()} values where {p.dtype} is declared")
    return df.select(*[F.col(d).cast(LABEL[a.program.dimensions[d].dtype]) for d in p.dims], F.col("value").cast(VALUE[p.dtype]))


def _first(rows: DataFrame, columns) -> str:
    r = rows.select(*columns).limit(1).collect()
    return ", ".join(f"{c}={v!r}" for c, v in r[0].asDict().items()) if r and columns else ""


def _probe(a: Attached, name: str, df: DataFrame, keys: tuple[str, ...], labels: dict[str, str], bad) -> DataFrame:
    """One row of facts about a table: rows, keys, rows that are bad, rows with an infinite value, rows with a stray label.

    Labels are looked up in the broadcast dimensions on the way to the one
    aggregate, so a table is read once, whatever is asked of it.
    """
    seen, strays = df, F.lit(False)
    for i, (c, d) in enumerate(labels.items()):
        seen = seen.join(a.dimension(d).select(F.col(d).alias(f"__l{i}")), F.col(c) == F.col(f"__l{i}"), "left")
        strays = strays | F.col(f"__l{i}").isNull()
    boundless = (F.abs("value") == float("inf")) if "value" in df.columns and isinstance(df.schema["value"].dataType, T.DoubleType) else F.lit(False)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    facts = [F.count("*").alias("n"), count(bad).alias("bad"), count(boundless).alias("inf"), count(strays).alias("strays")]
    if keys:
        seen = seen.groupBy(*keys).agg(*facts)
        return seen.agg(F.lit(name).alias("name"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in ("n", "bad", "inf", "strays")], F.count("*").alias("keys"))
    return seen.agg(F.lit(name).alias("name"), *facts, F.least(F.count("*"), F.lit(1)).cast("bigint").alias("keys"))


def _stray(a: Attached, df: DataFrame, labels: dict[str, str]) -> str:
    """The first label that no dimension has, and which it should be of."""
    for c, d in labels.items():
        beyond = df.select(c).join(a.dimension(d).select(F.col(d).alias("__label")), F.col(c) == F.col("__label"), "left_anti")
        if found := _first(beyond, [c]):
            return f"{found} is no label of {d}"
    return "a label is of no dimension"


def attach(spark: SparkSession, program: Program, sources: dict, check: bool = True) -> Attached:
    """Read and check the tables of all declarations: one look at each dimension, all at a time, and one job for all other tables.

    Details of what is wrong are looked up only where something is.
    """
    a = Attached(spark, program)
    known = {*program.dimensions, *program.relations, *program.parameters}
    for name in sources:
        if name not in known:
            raise DataError(f"unknown source {name}" + program.hint(name))
    for name in program.dimensions:
        if name not in sources:
            raise DataError(f"no labels for dimension {name}")
    with ThreadPoolExecutor(8) as pool:  # what each waits for is a small job
        found = pool.map(inheritable_thread_target(spark)(lambda name: _index(spark, program, name, sources[name])), program.dimensions)
        for name, (table, n, size) in zip(program.dimensions, found, strict=True):
            a.dimensions[name], a.sizes[name], a.bytes[name] = table, n, size
    probes: list[DataFrame] = []
    for name, r in program.relations.items():
        if name not in sources:
            raise DataError(f"no table for relation {name}")
        df = _frame(spark, sources[name], [*r.columns])
        _missing(df, [*r.columns], f"relation {name}")
        a.relations[name] = df.select(*[F.col(c).cast(LABEL[program.dimensions[d].dtype]) for c, d in r.columns.items()])
        null = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in r.columns])
        probes.append(_probe(a, name, a.relations[name], r.key or tuple(r.columns), r.columns, null))
    for name, p in program.parameters.items():
        if name not in sources:
            if not isinstance(p.missing, (int, float)) or isinstance(p.missing, bool) and p.dtype != "bool":
                raise DataError(f"no values for parameter {name}")
            a.parameters[name] = a.product(p.dims).select(*p.dims, F.lit(p.missing).cast(VALUE[p.dtype]).alias("value"))
            a.finite.add(name)
            continue
        a.parameters[name] = _parameter(a, p, sources[name])
        bad = F.col("value").isNull() | (F.isnan("value") if p.dtype == "float" else F.lit(False))
        probes.append(_probe(a, name, a.parameters[name], p.dims, {d: d for d in p.dims}, bad))
    if check and probes:
        for r in reduce(DataFrame.unionByName, probes).collect():
            _judge(a, r)
    for name, p in program.parameters.items():
        if name in sources and p.missing not in ("refused", "neutral", "absent"):
            df = a.given[name] = a.parameters[name]
            if p.dims:
                a.parameters[name] = a.product(p.dims).join(df, [*p.dims], "left").select(*p.dims, F.coalesce("value", F.lit(p.missing).cast(VALUE[p.dtype])).alias("value"))
    return a


def _judge(a: Attached, facts) -> None:
    """Refuse a table that its facts speak against, and say where."""
    name = facts["name"]
    if name in a.program.relations:
        r, df = a.program.relations[name], a.relations[name]
        if facts["bad"] or facts["keys"] < facts["n"]:
            raise DataError(f"relation {name}: a null, or a key that is there twice")
        if facts["strays"]:
            raise DataError(f"relation {name}: {_stray(a, df, r.columns)}")
        dims = tuple(r.columns[c] for c in r.key)
        if r.missing == "refused" and r.key and facts["n"] < a.size(dims):
            gap = a.product(dims).join(df.select(*[F.col(c).alias(r.columns[c]) for c in r.key]), [*dims], "left_anti")
            raise DataError(f"relation {name}: no row for {_first(gap, gap.columns)}")
        return
    p, df = a.program.parameters[name], a.parameters[name]
    if facts["bad"]:
        bad = F.col("value").isNull() | (F.isnan("value") if p.dtype == "float" else F.lit(False))
        raise DataError(f"parameter {name}: a value is null or NaN: {_first(df.filter(bad), p.dims)}")
    if facts["keys"] < facts["n"]:
        raise DataError(f"parameter {name}: two rows for a coordinate: {_first(df.groupBy(*p.dims).count().filter('count > 1'), p.dims)}")
    if facts["strays"]:
        raise DataError(f"parameter {name}: {_stray(a, df, {d: d for d in p.dims})}")
    if p.missing == "refused" and facts["n"] < a.size(p.dims):
        gap = _first(a.product(p.dims).join(df, [*p.dims], "left_anti"), p.dims) if p.dims else "the scalar"
        raise DataError(f"parameter {name}: no row for {gap}")
    if not facts["inf"]:
        a.finite.add(name)


def tidy(a: Attached) -> dict[str, DataFrame]:
    """The attached tables under their names; dimensions with their position."""
    return {**a.dimensions, **a.relations, **a.parameters}

