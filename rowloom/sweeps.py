"""Sweeps: one model per slice of the data, by label or by window along an ordered dimension."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.api import OUTPUTS, RECORD, Model, Result, Saved, load_result
from rowloom.errors import DataError, LanguageError, LayoutError, NoSolutionError
from rowloom.functions.formula import Call, names
from rowloom.plans.spec import load, program
from rowloom.sources import door


@dataclass(frozen=True)
class EachLabel:
    """One slice per label of a column that the specification doesn't declare; slices are in label order.

    carry: {parameter: expression}: after a slice, the expression's value becomes the next slice's parameter.
    """

    dim: str
    carry: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class EachWindow:
    """Windows of `steps` labels of an ordered dimension, each with `lookahead` labels more that it sees but doesn't own."""

    dim: str
    steps: int
    lookahead: int = 0
    carry: dict[str, str] = field(default_factory=dict)


def windows(table: DataFrame, dim: str, steps: int, lookahead: int = 0) -> DataFrame:
    """(window, dim, ord, owned): which labels each window sees, and which of them it owns.

    A label is in its own window and in those before whose lookahead reaches it,
    so each makes a bounded number of rows and nothing is joined.
    """
    own = F.floor(F.col("ord") / steps).cast("bigint")
    first = F.greatest(F.lit(0), F.ceil((F.col("ord") - (steps + lookahead - 1)) / steps).cast("bigint"))
    seen = table.select(F.explode(F.sequence(first, own)).alias("window"), dim, "ord", own.alias("__own"))
    return seen.select("window", dim, "ord", (F.col("window") == F.col("__own")).alias("owned"))


def stitched(frame: DataFrame, seen: DataFrame, dim: str) -> DataFrame:
    """Rows of (window, dim, ...) from the window that owns their label."""
    return frame.join(seen.filter("owned").select("window", dim), ["window", dim], "left_semi")


@dataclass
class Sweep:
    """Answers of all slices: result tables with the slice's key in front."""

    key: str
    results: dict[object, Result | Saved]
    axis: object
    owned: DataFrame | None = None

    def _gathered(self, read) -> DataFrame:
        out = None
        for k, r in self.results.items():
            part = read(r)
            part = part.select(F.lit(k).alias(self.key), *part.columns)
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise NoSolutionError("the sweep has no slice")
        return out

    def _stitch(self, frame: DataFrame, per_window: bool) -> DataFrame:
        if per_window or self.owned is None or self.axis.dim not in frame.columns:
            return frame
        return stitched(frame, self.owned, self.axis.dim).drop(self.key)

    def read(self, kind: str, name: str, per_window: bool = False) -> DataFrame:
        """A table of every slice: primal, dual, expression, or a kind of OUTPUTS that the slices carry."""
        if kind not in ("primal", "dual", "expression", *OUTPUTS):
            raise NoSolutionError(f"no {kind}")
        return self._stitch(self._gathered(lambda r: r.evaluate(name) if kind == "expression" and isinstance(r, Result) else getattr(r, kind)(name)), per_window)

    def primal(self, name: str, per_window: bool = False) -> DataFrame:
        return self.read("primal", name, per_window)

    def dual(self, name: str, per_window: bool = False) -> DataFrame:
        return self.read("dual", name, per_window)

    def reduced_cost(self, name: str, per_window: bool = False) -> DataFrame:
        return self.read("reduced_cost", name, per_window)

    def slack(self, name: str, per_window: bool = False) -> DataFrame:
        return self.read("slack", name, per_window)

    def activity(self, name: str, per_window: bool = False) -> DataFrame:
        return self.read("activity", name, per_window)

    def evaluate(self, expression: str, per_window: bool = False) -> DataFrame:
        return self.read("expression", expression, per_window)

    @property
    def records(self) -> list[dict]:
        rows = {k: dict(zip((f.split()[0] for f in RECORD.split(", ")), r.record, strict=True)) for k, r in self.results.items()}
        return [{self.key: k} | r for k, r in rows.items()]

    def save(self, path: str, outputs: tuple[str, ...] = ()) -> str:
        """Every slice's answer below <path>/slice=<key>."""
        for k, r in self.results.items():
            if isinstance(r, Result):
                r.save(f"{path}/slice={k}", outputs)
        return path


def _cut(sources: dict, frames: dict[str, DataFrame], keep: DataFrame, column: str, drop: bool) -> dict:
    """Sources restricted to the labels of a slice; those without its column are as they were."""
    out = dict(sources)
    for name, df in frames.items():
        if column in df.columns:
            cut = df.join(keep.select(column), column, "left_semi")
            out[name] = cut.drop(column) if drop else cut
    return out


def _coupled(p, dim: str) -> list[str]:
    """Constraints that walk along the dimension, which a cut into windows changes at the seams."""
    def walks(node) -> bool:
        if isinstance(node, Call) and node.name in ("shift", "sum_back") and dim in names(node.get("along")):
            return True
        return any(walks(x) for x in [*getattr(node, "args", ()), *(v for _, v in getattr(node, "kwargs", ())), *(getattr(node, s) for s in ("left", "right", "of") if hasattr(node, s))])

    return [c.name for c in p.constraints.values() if walks(c.left) or walks(c.right)]


@dataclass
class Slices:
    """What an axis cuts: the slices' keys with the labels that each keeps, and the sources as frames."""

    spark: SparkSession
    spec: dict
    sources: dict
    axis: EachLabel | EachWindow
    frames: dict[str, DataFrame]
    keys: list
    keep: dict[object, DataFrame]
    owned: DataFrame | None
    key: str

    def of(self, k) -> dict:
        """The sources of one slice."""
        keep, dim = self.keep[k], self.axis.dim
        own = _cut(self.sources, self.frames, keep, dim, isinstance(self.axis, EachLabel))
        if isinstance(self.axis, EachWindow):
            own[dim] = keep.select(dim, "ord").withColumn("ord", F.col("ord") - F.lit(keep.agg(F.min("ord")).first()[0]))
        return own

    def carried(self, k, result) -> dict:
        """Parameters of the next slice from this one's answer."""
        out, p = {}, program(self.spec)
        for parameter, expression in self.axis.carry.items():
            values = result.evaluate(expression)
            if isinstance(self.axis, EachWindow) and self.axis.dim in values.columns:  # the last label that the window owns
                seam = self.keep[k].filter("owned").orderBy(F.col("ord").desc()).limit(1).select(self.axis.dim)
                values = values.join(seam, self.axis.dim, "left_semi").drop(self.axis.dim)
            dims = p.parameters[parameter].dims
            # a few values that outlive the slice's model
            out[parameter] = self.spark.createDataFrame(values.select(*dims, "value").collect(), values.select(*dims, "value").schema) if dims else values.first()["value"]
        return out


def slices(spark: SparkSession, spec, sources: dict, axis: EachLabel | EachWindow) -> Slices:
    spec, p = load(spec), program(spec)
    frames = {n: s if isinstance(s, DataFrame) else None for n, s in sources.items()}
    for n, s in sources.items():
        if frames[n] is None and not isinstance(s, (int, float, str, bool)):
            columns = [n] if n in p.dimensions else [*p.relations[n].columns] if n in p.relations else [*p.parameters[n].dims, "value"]
            if n in p.parameters and isinstance(s, (list, tuple)) and list(p.parameters[n].dims) == [axis.dim]:  # values by position
                labels = [r[0] for r in door._index(spark, p, axis.dim, sources[axis.dim])[0].orderBy("ord").select(axis.dim).collect()]
                frames[n] = spark.createDataFrame([*zip(labels, s, strict=True)], [axis.dim, "value"])
                continue
            try:
                frames[n] = door._frame(spark, s if not (n in p.dimensions and isinstance(s, (list, tuple, range))) else {n: list(s)}, columns)
            except DataError:
                frames[n] = None
    frames = {n: f for n, f in frames.items() if f is not None}
    if stray := [n for n in axis.carry if n not in p.parameters]:
        raise LanguageError(f"carry: no parameter {stray[0]}")
    if isinstance(axis, EachLabel):
        if axis.dim in p.dimensions:
            raise LanguageError(f"{axis.dim} is a dimension of the model; EachLabel slices by a column that isn't")
        having = [f.select(axis.dim) for f in frames.values() if axis.dim in f.columns]
        if not having:
            raise DataError(f"no source has a column {axis.dim}")
        labels = having[0]
        for f in having[1:]:
            labels = labels.union(f)
        keep = {r[0]: spark.createDataFrame([(r[0],)], labels.schema) for r in labels.distinct().orderBy(axis.dim).collect()}
        return Slices(spark, spec, sources, axis, frames, [*keep], keep, None, axis.dim)
    if axis.dim not in p.dimensions or not p.dimensions[axis.dim].ordered:
        raise LanguageError(f"{axis.dim} isn't an ordered dimension")
    if not axis.carry and not axis.lookahead and (seams := _coupled(p, axis.dim)):
        raise LanguageError(f"{', '.join(seams)} walk along {axis.dim}; windows need lookahead or carry")
    index = door._index(spark, p, axis.dim, sources[axis.dim])[0]
    owned = windows(index, axis.dim, axis.steps, axis.lookahead).persist()
    keep = {r[0]: owned.filter(F.col("window") == r[0]) for r in owned.select("window").distinct().orderBy("window").collect()}
    return Slices(spark, spec, sources, axis, frames, [*keep], keep, owned, "window")


def build_slice(spark: SparkSession, spec, sources: dict, axis: EachLabel | EachWindow, key, *, sweep: Sweep | None = None) -> Model:
    """The model of one slice, as `solve_over` builds it; with `sweep`, carried parameters are what the slice before left."""
    cut = slices(spark, spec, sources, axis)
    if key not in cut.keep:
        raise DataError(f"no slice {key}")
    at = cut.keys.index(key)
    carried = cut.carried(cut.keys[at - 1], sweep.results[cut.keys[at - 1]]) if sweep is not None and axis.carry and at else {}
    return Model(spark, cut.spec, cut.of(key) | carried)


def solve_over(spark: SparkSession, spec, sources: dict, axis: EachLabel | EachWindow, *, workers: int = 1, spill_to: str | None = None, outputs: tuple[str, ...] = (), start: str | None = "previous") -> Sweep:
    """Solve the model for every slice; a carried value goes from each slice into the next.

    Without a carry, `workers` slices are built and solved at a time. With
    `spill_to`, every slice's answer is written there as it comes and read back
    from there, its model is let go, and a slice that is there already isn't
    solved again, so an interrupted sweep goes on where it was. `start` hands
    each slice the answer of the one before to begin with, where slices follow
    one another; None doesn't.
    """
    cut = slices(spark, spec, sources, axis)
    if workers > 1 and axis.carry:
        raise LanguageError("a carry chains the slices; they can't be solved at a time")

    def solved(k, carried: dict, before: Result | None):
        place = f"{spill_to}/slice={k}"
        if spill_to is not None and not axis.carry:
            try:
                return load_result(spark, place)
            except LayoutError:
                pass
        model = Model(spark, cut.spec, cut.of(k) | carried)
        result = model.solve(start=before)
        if spill_to is not None:
            result.save(place, outputs)
        model.close()  # the answer's tables are still there, but not kept in memory for every slice
        return load_result(spark, place) if spill_to is not None and not axis.carry else result

    results: dict = {}
    if workers > 1:
        with ThreadPoolExecutor(workers) as pool:
            results = dict(zip(cut.keys, pool.map(inheritable_thread_target(spark)(lambda k: solved(k, {}, None)), cut.keys), strict=True))
        return Sweep(cut.key, results, axis, cut.owned)
    carried, before = {}, None
    for k in cut.keys:
        results[k] = solved(k, carried, before if isinstance(before, Result) else None)
        before = results[k] if start == "previous" else None
        if axis.carry:
            carried = cut.carried(k, results[k])
    return Sweep(cut.key, results, axis, cut.owned)


def load_sweep(spark: SparkSession, path: str, key: str = "slice") -> Sweep:
    """A saved or spilled sweep: whole slices only, in the order of their names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder))
    results = {}
    for n in names:
        if n.startswith("slice="):
            try:
                results[n.removeprefix("slice=")] = load_result(spark, f"{path}/{n}")
            except LayoutError:
                continue
    return Sweep(key, results, None)
