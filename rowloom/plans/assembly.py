"""The model's sparse tables, built from the compiled declarations.

cols(col, lb, ub, vtype)   obj(col, coeff)   quad(col_l, col_r, coeff)
rows(row, sense, rhs)      matrix(row, col, coeff)
qmatrix(row, col_l, col_r, coeff)            sos(set, type, col, weight)

Columns and rows are numbered densely, row-major over each declaration's
product. Only counts reach the driver; the tables stay lazy until a sink asks.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.errors import DataError
from rowloom.functions.formula import Num, Unary
from rowloom.plans.compiler import Compiled, Compiler, Term, negated, range_counts, ranked
from rowloom.sources.door import Attached

SCHEMAS = {
    "cols": "col bigint, lb double, ub double, vtype string",
    "obj": "col bigint, coeff double",
    "quad": "col_l bigint, col_r bigint, coeff double",
    "rows": "row bigint, sense string, rhs double",
    "matrix": "row bigint, col bigint, coeff double",
    "qmatrix": "row bigint, col_l bigint, col_r bigint, coeff double",
    "sos": "`set` bigint, type int, col bigint, weight bigint",
}
ROUNDING = 1e-6


@dataclass
class Handoff:
    """A built model. variables, constraints: (dims..., var / row) by name; the tables as above."""

    attached: Attached
    sense: str
    constant: float = 0.0
    n_cols: int = 0
    n_rows: int = 0
    variables: dict[str, DataFrame] = field(default_factory=dict)
    constraints: dict[str, DataFrame] = field(default_factory=dict)
    spans: dict[str, tuple[int, int]] = field(default_factory=dict)  # first label and count of each declaration
    tables: dict[str, DataFrame] = field(default_factory=dict)
    omitted: dict[str, int] = field(default_factory=dict)  # coordinates of each declaration that have no row or column
    kinds: set[str] = field(default_factory=set)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.tables[name]
        raise AttributeError(name)


def _constant(node) -> float | None:
    if node is None:
        return None
    if isinstance(node, Num):
        return float(node.value)
    if isinstance(node, Unary) and isinstance(node.of, Num):
        return -float(node.of.value)
    return None


@dataclass
class Placed:
    """A compiled constraint; `whole` says that it has a row at every coordinate."""

    constraint: object
    frame: DataFrame
    whole: bool
    terms: list[Term] = field(default_factory=list)
    constants: list[Term] = field(default_factory=list)


class Assembly:
    def __init__(self, attached: Attached):
        self.a, self.p = attached, attached.program
        self.h = Handoff(attached, self.p.sense)
        self.c = Compiler(attached, self.h.variables)
        self.asked: list[tuple[str, DataFrame]] = []  # what must have no row, and what is said if it has

    def run(self) -> Handoff:
        variables = [*self.p.variables.values()]
        masked = [self.position(self.c.masked(v.dims, v.where, ords=True), v.dims) for v in variables]
        counts = self.counted([(f, v.dims, v.where is None or not self.a.size(v.dims)) for f, v in zip(masked, variables, strict=True)])
        cols = [self.variable(*x) for x in zip(variables, masked, counts, strict=True)]
        sos = [self.sos(i, s) for i, s in enumerate(self.p.sos.values())]
        self.h.kinds |= {"sos"} if self.p.sos else set()
        parts: dict[str, list[DataFrame]] = {"rows": [], "matrix": [], "qmatrix": []}
        linear = [c for c in self.p.constraints.values() if max(self.p.degree(c.left), self.p.degree(c.right)) < 2]
        placed = [self.placed(c) for c in [*linear, *(c for c in self.p.constraints.values() if c not in linear)]]  # quadratic rows come last
        for x, n in zip(placed, self.counted([(x.frame, x.constraint.dims, x.whole) for x in placed]), strict=True):
            for name, table in self.constraint(x, n).items():
                parts[name].append(table)
        self.objective()
        self.settle()
        self.h.tables |= {"cols": self.union(cols, "cols"), "sos": self.union(sos, "sos"), **{n: self.union(t, n) for n, t in parts.items()}}
        return self.h

    def settle(self) -> None:
        """One job for all that could be wrong with the numbers; the first thing found is raised."""
        if not self.asked:
            return
        where = lambda df: F.to_json(F.struct(*df.columns)) if df.columns else F.lit("{}")
        looked = [df.limit(1).select(F.lit(i).alias("i"), where(df).alias("at")) for i, (_, df) in enumerate(self.asked)]
        if found := reduce(DataFrame.unionByName, looked).collect():
            first = min(found, key=lambda r: r["i"])
            raise DataError(f"{self.asked[first['i']][0]} at {json.loads(first['at'])}")

    def union(self, tables: list[DataFrame], name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, tables) if tables else self.a.spark.createDataFrame([], SCHEMAS[name])

    def position(self, frame: DataFrame, dims: tuple[str, ...]) -> DataFrame:
        """The row-major position of every coordinate in the whole product, from ord_<dim> columns."""
        at = F.lit(0).cast("bigint")
        for d in dims:
            at = at * F.lit(self.a.sizes[d]) + F.col(f"ord_{d}")
        return frame.withColumn("__at", at)

    def counted(self, frames: list[tuple[DataFrame, tuple[str, ...], bool]]) -> list[dict[int, int] | None]:
        """Range counts of every frame that isn't whole, all at a time: what each waits for is a small job."""
        look = inheritable_thread_target(self.a.spark)(lambda x: None if x[2] else range_counts(x[0], "__at", max(1, self.a.size(x[1]))))
        with ThreadPoolExecutor(8) as pool:
            return [*pool.map(look, frames)]

    def labelled(self, frame: DataFrame, dims: tuple[str, ...], label: str, start: int, counts: dict[int, int] | None) -> tuple[DataFrame, int]:
        if counts is None:  # nothing is masked: the position is the label
            return frame.withColumn(label, F.col("__at") + F.lit(start)), self.a.size(dims)
        return ranked(frame, "__at", label, max(1, self.a.size(dims)), counts, start), sum(counts.values())

    def variable(self, v, masked: DataFrame, counts: dict[int, int] | None) -> DataFrame:
        if not self.a.size(v.dims):  # over no label: nothing to compile
            frame = self.c.masked(v.dims, None, ords=True).withColumn("var", F.lit(0).cast("bigint")).filter(F.lit(False))
            self.h.variables[v.name], self.h.spans[v.name], self.h.omitted[v.name] = frame, (self.h.n_cols, 0), 0
            return self.union([], "cols")
        frame, n = self.labelled(masked, v.dims, "var", self.h.n_cols, counts)
        frame = frame.drop("__at").persist()
        self.h.variables[v.name], self.h.spans[v.name] = frame, (self.h.n_cols, n)
        self.h.omitted[v.name] = self.a.size(v.dims) - n
        self.h.n_cols += n
        if v.domain != "continuous":
            self.h.kinds.add("integrality")
        sides = {"lb": (v.lower, 0.0 if v.domain == "binary" else float("-inf")), "ub": (v.upper, 1.0 if v.domain == "binary" else float("inf"))}
        out = frame
        for side, (node, default) in sides.items():
            if node is None or _constant(node) is not None:
                out = out.withColumn(side, F.lit(default if node is None else _constant(node)))
                continue
            bound, dims = self.c.value_or_gap(node)
            out = out.join(bound.withColumnRenamed("v", side), list(dims), "left") if dims else out.crossJoin(bound.withColumnRenamed("v", side))
            own = self.c.expression(node)
            if own.presences or not all(t.full for t in own.terms) or any(t.risky and t.names and not t.plain for t in own.terms):
                self.asked.append((f"variable {v.name}: a bound has no value", out.filter(F.col(side).isNull()).select(*v.dims)))
        if v.domain != "continuous":
            near = lambda c: F.when((F.abs(c - F.round(c)) < ROUNDING) & (F.abs(c) < float("inf")), F.round(c))
            out = out.withColumns({s: F.coalesce(near(F.col(s)), F.col(s)) for s in sides})
        return out.select(F.col("var").alias("col"), "lb", "ub", F.lit(v.domain).alias("vtype"))

    def sos(self, i: int, s) -> DataFrame:
        """One set per line along the dimension; set and weight come from the ordinals."""
        v = self.p.variables[s.variable]
        at = F.lit(0).cast("bigint")
        for d in v.dims:
            if d != s.along:
                at = at * F.lit(self.a.sizes[d]) + F.col(f"ord_{d}")
        first = sum(self.a.size([d for d in self.p.variables[x.variable].dims if d != x.along]) for x in list(self.p.sos.values())[:i])
        return self.h.variables[s.variable].select((at + F.lit(first)).alias("set"), F.lit(s.kind).alias("type"), F.col("var").alias("col"), (F.col(f"ord_{s.along}") + 1).alias("weight"))

    def placed(self, c) -> Placed:
        """A constraint's terms, and where it has rows."""
        if not self.a.size(c.dims):  # over no label: nothing to compile
            return Placed(c, self.position(self.c.masked(c.dims, None, ords=True), c.dims), True)
        left, right = self.c.expression(c.left), self.c.expression(c.right)
        terms = [t for t in left.terms if t.kind != "const"] + [negated(t) for t in right.terms if t.kind != "const"]
        constants = right.of("const") + [negated(t) for t in left.of("const")]
        if not terms:
            raise DataError(f"constraint {c.name} has no variable")
        presences = left.presences + right.presences
        frame = self.c.within(self.c.masked(c.dims, c.where, ords=True), c.dims, presences)
        # a row needs at least one of its variables, whatever the coefficient; one that is everywhere settles that
        certain = any(t.whole and set(t.dims) <= set(c.dims) for t in terms)
        if not certain:
            there = [self.c.join(frame, t.frame.select(*t.dims).distinct(), t.dims, "left_semi") for t in terms]
            frame = reduce(DataFrame.unionByName, there).distinct() if len(there) > 1 else there[0]
            frame = frame if c.dims else frame.limit(1)
        return Placed(c, self.position(frame, c.dims), certain and c.where is None and not presences, terms, constants)

    def constraint(self, x: Placed, counts: dict[int, int] | None) -> dict[str, DataFrame]:
        c, terms, constants = x.constraint, x.terms, x.constants
        if not self.a.size(c.dims):
            self.h.constraints[c.name] = x.frame.drop("__at").withColumn("row", F.lit(0).cast("bigint"))
            self.h.spans[f"constraint:{c.name}"], self.h.omitted[f"constraint:{c.name}"] = (self.h.n_rows, 0), 0
            return {}
        rows, n = self.labelled(x.frame, c.dims, "row", self.h.n_rows, counts)
        rows = rows.drop("__at").persist()
        self.h.constraints[c.name], self.h.spans[f"constraint:{c.name}"] = rows, (self.h.n_rows, n)
        self.h.omitted[f"constraint:{c.name}"] = self.a.size(c.dims) - n
        self.h.n_rows += n
        side = self.sided(rows, c, constants)
        number = rows.select(*c.dims, "row")
        out = {"rows": side.select("row", F.lit(c.sense).alias("sense"), F.col("v").alias("rhs"))}
        placed = lambda kind: [(t, self.c.join(t.frame.select(*t.dims, *t.labels, "v"), number, t.dims)) for t in terms if t.kind == kind]
        if linear := [x.select("row", F.col("var").alias("col"), "v") for _, x in placed("lin")]:
            out["matrix"] = self.summed(reduce(DataFrame.unionByName, linear), ["row", "col"], f"constraint {c.name}", terms)
        if quadratic := [x.select("row", F.least("var", "var2").alias("col_l"), F.greatest("var", "var2").alias("col_r"), "v") for _, x in placed("quad")]:
            self.h.kinds.add("quadratic_constraint")
            out["qmatrix"] = self.summed(reduce(DataFrame.unionByName, quadratic), ["row", "col_l", "col_r"], f"constraint {c.name}", terms)
        return out

    def sided(self, rows: DataFrame, c, constants: list[Term]) -> DataFrame:
        """rhs of every row. A side that is data alone must cover all rows; other gaps add nothing."""
        alone = [t for t in constants if t.plain and len(constants) == 1 and t.names]
        side = self.c.added(rows.select(*c.dims, "row"), c.dims, constants) if not alone else self.c.join(rows.select(*c.dims, "row"), alone[0].frame.select(*alone[0].dims, "v"), alone[0].dims, "left" if alone[0].dims else "inner")
        sure = all(t.full and not t.risky for t in constants)
        if constants and any(t.names for t in constants) and not sure:
            self.asked.append((f"constraint {c.name}: no value for the constant side", side.filter(F.col("v").isNull() | F.isnan("v")).select(*c.dims, "row")))
        return side

    def summed(self, entries: DataFrame, keys: list[str], what: str, terms: list[Term]) -> DataFrame:
        """One entry per key, exact zeros left out. Only computed or given coefficients can be null or infinite, so only they are asked about."""
        if any(t.risky for t in terms):
            names = ", ".join(dict.fromkeys(n for t in terms for n in t.names))
            bad = entries.filter(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).select(*keys)
            self.asked.append((f"{what}: a coefficient from {names} is missing or not finite", bad))
        return entries.groupBy(*keys).agg(F.sum("v").alias("coeff")).filter("coeff <> 0")

    def objective(self) -> None:
        c = self.c.expression(self.p.objective) if self.p.objective is not None else Compiled()
        terms = self.c.settled(c)
        linear = [t.frame.select(F.col("var").alias("col"), "v") for t in terms if t.kind == "lin"]
        quadratic = [t.frame.select(F.least("var", "var2").alias("col_l"), F.greatest("var", "var2").alias("col_r"), "v") for t in terms if t.kind == "quad"]
        own = [t for t in terms if t.kind != "const"]
        self.h.tables["obj"] = self.summed(reduce(DataFrame.unionByName, linear), ["col"], "the objective", own) if linear else self.union([], "obj")
        self.h.tables["quad"] = self.summed(reduce(DataFrame.unionByName, quadratic), ["col_l", "col_r"], "the objective", own) if quadratic else self.union([], "quad")
        if quadratic:
            self.h.kinds.add("quadratic_objective")
        for t in terms:
            if t.kind == "const":
                self.h.constant += t.frame.agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]


def build(attached: Attached) -> Handoff:
    check_assumptions(attached)
    return Assembly(attached).run()


def check_assumptions(a: Attached) -> None:
    """Every assumption holds wherever its own mask lets it be asked."""
    c = Compiler(a)
    for curve in a.program.curves:
        check_curve(a, *curve)
    for name, (holds, where) in a.program.assumptions.items():
        dims = a.program.ordered((*a.program.dims(holds), *(a.program.dims(where) if where is not None else ())))
        asked = c.masked(dims, where)
        broken = c.join(asked, c.admitted(holds), a.program.dims(holds), "left_anti") if dims else asked.join(c.admitted(holds), F.lit(True), "left_anti")
        if found := broken.limit(1).collect():
            raise DataError(f"assumption {name} fails" + (f" at {found[0].asDict()}" if dims else ""))


def check_curve(a: Attached, name: str, over: str, x: str, y: str, sense: str) -> None:
    """The slopes of a curve without binaries must not fall; for <= not rise."""
    if x not in a.parameters or y not in a.parameters:
        return
    xs, ys = a.program.parameters[x].dims, a.program.parameters[y].dims
    points = a.parameters[x].withColumnRenamed("value", "__x").join(a.parameters[y].withColumnRenamed("value", "__y"), [d for d in xs if d in ys])
    lines = [d for d in points.columns if d not in (over, "__x", "__y")]
    w = Window.partitionBy(*lines).orderBy("ord")
    slope = F.try_divide(F.col("__y") - F.lag("__y").over(w), F.col("__x") - F.lag("__x").over(w))
    sloped = points.join(a.dimension(over), over).withColumn("__s", slope)
    turn = (F.col("__s") - F.lag("__s").over(w)) * (-1 if sense == "<=" else 1)
    found = sloped.withColumn("__turn", turn).filter(F.col("__turn") < -ROUNDING).limit(1).select(*lines, over).collect()
    if found:
        raise DataError(f"piecewise {name}: the curve is not {'concave' if sense == '<=' else 'convex'} at {found[0].asDict()}")


def diagnostics(h: Handoff) -> dict[str, tuple[float, float] | None]:
    """Least and greatest size of the numbers other than zero in each table."""
    def spread(df: DataFrame, column: str):
        v = F.abs(column)
        r = df.filter((F.col(column) != 0) & (v < float("inf"))).agg(F.min(v), F.max(v)).first()
        return None if r[0] is None else (r[0], r[1])

    bounds = h.cols.select(F.explode(F.array("lb", "ub")).alias("b"))
    return {"matrix": spread(h.matrix, "coeff"), "objective": spread(h.obj, "coeff"), "rhs": spread(h.rows, "rhs"), "bounds": spread(bounds, "b")}


def row_starts(h: Handoff) -> DataFrame:
    """(row, start): the first entry of each row in the matrix by rows; counts of at most 1024 ranges reach the driver."""
    counted = h.rows.select("row").join(h.matrix.groupBy("row").agg(F.count("*").alias("n")), "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    width = max(1, -(-h.n_rows // 1024))
    dealt = counted.withColumn("__range", F.floor(F.col("row") / width).cast("bigint"))
    sums, before, total = {r[0]: r[1] for r in dealt.groupBy("__range").agg(F.sum("n")).collect()}, [], 0
    for k in sorted(sums):
        before.append((k, total))
        total += sums[k]
    small = h.attached.spark.createDataFrame(before, "__range bigint, __before bigint")
    ahead = Window.partitionBy("__range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(small), "__range").select("row", (F.col("__before") + F.coalesce(F.sum("n").over(ahead), F.lit(0))).cast("bigint").alias("start"))


def structure(h: Handoff) -> str:
    """A digest of what new numbers may not change in a loaded model: counts, sense, types, comparisons, where the entries sit, sets, and quadratic rows whole.

    Bounds, costs, right sides of linear rows and coefficients aren't in it.
    The digest is a sum of row hashes, so it needs no order and one pass.
    """
    quadratic = h.qmatrix.select("row").distinct()
    parts = {
        "cols": h.cols.select("col", "vtype"),
        "rows": h.rows.select("row", "sense"),
        "matrix": h.matrix.select("row", "col"),
        "quad": h.quad.select("col_l", "col_r"),
        "qmatrix": h.qmatrix,
        "qrows": h.rows.join(quadratic, "row", "left_semi").select("row", "rhs"),
        "sos": h.sos,
    }
    sums = [df.agg(F.lit(n).alias("n"), F.count("*").alias("rows"), F.sum(F.xxhash64(F.lit(n), *df.columns).cast("decimal(38,0)")).cast("string").alias("sum")) for n, df in parts.items()]
    found = sorted(tuple(map(str, r)) for r in reduce(DataFrame.unionByName, sums).collect())
    return hashlib.sha256(json.dumps([h.n_cols, h.n_rows, h.sense, found]).encode()).hexdigest()


def sparse_parameters(a: Attached) -> DataFrame:
    """(parameter, coordinates, rows, missing) of the parameters that lack rows as given."""
    counted = [(a.given.get(n, a.parameters[n])).agg(F.lit(n).alias("parameter"), F.lit(a.size(p.dims)).cast("bigint").alias("coordinates"), F.count("*").alias("rows")) for n, p in a.program.parameters.items() if p.dims]
    if not counted:
        return a.spark.createDataFrame([], "parameter string, coordinates bigint, rows bigint, missing bigint")
    return reduce(DataFrame.unionByName, counted).withColumn("missing", F.col("coordinates") - F.col("rows")).filter("missing > 0")
