"""The calls: check, tidy, evaluate, build, solve, write, and what they return."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.errors import LanguageError, LayoutError, NoSolutionError
from rowloom.functions.formula import Call, parse
from rowloom.plans.assembly import Handoff, build as assemble, check_assumptions, diagnostics, sparse_parameters, structure
from rowloom.plans.compiler import Compiler
from rowloom.plans.spec import Cases, Program, _expand, load, program
from rowloom.sinks import solver, text
from rowloom.sources import door

#: What a solution can be asked for besides primal and dual values.
OUTPUTS = ("activity", "slack", "reduced_cost", "variable_basis", "constraint_basis", "dual_ray")
#: How a solve ended, rolled up.
STATES = {
    **dict.fromkeys(("optimal", "time_limit", "iteration_limit", "node_limit", "terminated_by_limit", "suboptimal", "imprecise"), "ok"),
    **dict.fromkeys(("infeasible", "infeasible_or_unbounded", "unbounded", "other"), "warning"),
    **dict.fromkeys(("internal_solver_error", "error"), "error"),
    **dict.fromkeys(("user_interrupt", "resource_interrupt", "licensing_problems"), "aborted"),
}
RECORD = "status string, termination_condition string, objective double, has_primal boolean, solved_at timestamp, solver string"


def check(spec) -> Program:
    """Parse, validate and expand a specification. Reads no data."""
    return program(spec)


def tidy(spark: SparkSession, spec, sources: dict) -> dict[str, DataFrame]:
    """The checked tables, dimensions with their position as `ord`."""
    return door.tidy(door.attach(spark, program(spec), sources))


def _ordered(a: door.Attached, frame: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Rows in label order; ordinals don't show."""
    out = frame
    for d in dims:
        out = out.join(a.dimension(d).select(d, F.col("ord").alias(f"__o_{d}")), d)
    return out.orderBy(*[f"__o_{d}" for d in dims]).select(*frame.columns) if dims else out


def evaluate(spark: SparkSession, spec, sources: dict, expression: str, *, ordered: bool = True) -> DataFrame:
    """(dims..., value) of arithmetic on data: a named expression or a formula of the specification's names."""
    p = program(spec)
    node = _expand(parse(expression), load(spec).get("macros") or {})
    if p.degree(node):
        raise LanguageError(f"{expression} has variables; evaluate it at a solution")
    a = door.attach(spark, p, sources)
    check_assumptions(a)
    frame, dims = Compiler(a, values={}).value(node)
    out = frame.select(*dims, F.col("v").alias("value"))
    return _ordered(a, out, dims) if ordered else out


@dataclass
class Result:
    """The answer of a solve, as tidy tables."""

    handoff: Handoff
    answer: solver.Answer
    values: dict[str, DataFrame] = field(default_factory=dict)
    duals: dict[str, DataFrame] = field(default_factory=dict)
    solved_at: datetime = field(default_factory=lambda: datetime.now(UTC))

    @property
    def status(self) -> str:
        return STATES.get(self.answer.status, "unknown")

    @property
    def termination_condition(self) -> str:
        return self.answer.status

    @property
    def objective(self) -> float:
        if self.answer.objective is None:
            raise NoSolutionError(f"the solver stopped as {self.answer.status}")
        return self.answer.objective

    def _vector(self, values: np.ndarray | None, label: str) -> DataFrame:
        if values is None:
            raise NoSolutionError("this solution has no such values")
        import pandas as pd

        return self.handoff.attached.spark.createDataFrame(pd.DataFrame({label: np.arange(len(values), dtype=np.int64), "v": np.asarray(values, dtype=float)}), f"{label} bigint, v double")

    def _laid(self, name: str, frame: DataFrame, label: str, vector: DataFrame) -> DataFrame:
        dims = (self.handoff.attached.program.variables if label == "var" else self.handoff.attached.program.constraints)[name].dims
        return frame.join(vector, label).select(*dims, "v")

    def load(self) -> Result:
        """Lay the vectors out over the declarations' coordinates."""
        if self.answer.x is None:
            raise NoSolutionError(f"the solver stopped as {self.answer.status}")
        x = self._vector(self.answer.x, "var")
        self.values = {n: self._laid(n, f, "var", x) for n, f in self.handoff.variables.items()}
        if self.answer.y is not None:
            y = self._vector(self.answer.y, "row")
            self.duals = {n: self._laid(n, f, "row", y) for n, f in self.handoff.constraints.items()}
        return self

    def _shown(self, frame: DataFrame, dims) -> DataFrame:
        return _ordered(self.handoff.attached, frame.select(*dims, F.col("v").alias("value")), dims)

    def primal(self, name: str) -> DataFrame:
        return self._shown(self.load().values[name], self.handoff.attached.program.variables[name].dims)

    def dual(self, name: str) -> DataFrame:
        if self.answer.y is None:
            raise NoSolutionError("this solution has no duals")
        return self._shown(self.load().duals[name], self.handoff.attached.program.constraints[name].dims)

    def _activity(self) -> DataFrame:
        """(row, v): the left side of every row at the solution."""
        x = self._vector(self.answer.x, "col")
        terms = self.handoff.matrix.join(x, "col").select("row", (F.col("coeff") * F.col("v")).alias("v"))
        if "quadratic_constraint" in self.handoff.kinds:
            left, right = x.toDF("col_l", "v_l"), x.toDF("col_r", "v_r")
            terms = terms.unionByName(self.handoff.qmatrix.join(left, "col_l").join(right, "col_r").select("row", (F.col("coeff") * F.col("v_l") * F.col("v_r")).alias("v")))
        return self.handoff.rows.select("row").join(terms.groupBy("row").agg(F.sum("v").alias("v")), "row", "left").select("row", F.coalesce("v", F.lit(0.0)).alias("v"))

    def activity(self, name: str) -> DataFrame:
        return self._shown(self._laid(name, self.handoff.constraints[name], "row", self._activity()), self.handoff.attached.program.constraints[name].dims)

    def slack(self, name: str) -> DataFrame:
        """Room of every row: right less left for <= and ==, left less right for >=."""
        room = slack_of(self.handoff.rows, self._activity())
        return self._shown(self._laid(name, self.handoff.constraints[name], "row", room), self.handoff.attached.program.constraints[name].dims)

    def reduced_cost(self, name: str) -> DataFrame:
        """c - A'y, at a quadratic objective with its gradient."""
        if self.answer.y is None:
            raise NoSolutionError("this solution has no duals")
        h = self.handoff
        cost = h.obj
        if "quadratic_objective" in h.kinds:
            x = self._vector(self.answer.x, "col")
            for one, other in (("col_l", "col_r"), ("col_r", "col_l")):
                cost = cost.unionByName(h.quad.join(x.withColumnRenamed("col", other), other).select(F.col(one).alias("col"), (F.col("coeff") * F.col("v")).alias("coeff")))
        d = reduced_costs(h.cols, cost, h.matrix, self._vector(self.answer.y, "row"))
        return self._shown(self._laid(name, h.variables[name], "var", d.withColumnRenamed("col", "var")), h.attached.program.variables[name].dims)

    def evaluate(self, expression: str) -> DataFrame:
        """(dims..., value) of a named expression or a formula at the solution; duals may be read."""
        self.load()
        frame, dims = Compiler(self.handoff.attached, values=self.values, duals=self.duals).value(parse(expression))
        return self._shown(frame, dims)

    def variable_basis(self, name: str) -> DataFrame:
        """(dims..., value): basic, at_lower, at_upper, fixed or superbasic."""
        return self._words(name, self.handoff.variables[name], "var", 0, self.handoff.n_cols)

    def constraint_basis(self, name: str) -> DataFrame:
        return self._words(name, self.handoff.constraints[name], "row", self.handoff.n_cols, self.handoff.n_rows)

    def _words(self, name: str, frame: DataFrame, label: str, first: int, n: int) -> DataFrame:
        if self.answer.basis is None:
            raise NoSolutionError("this solution has no basis")
        rows = [(i, str(w)) for i, w in enumerate(self.answer.basis[first : first + n])]
        laid = self._laid(name, frame, label, self.handoff.attached.spark.createDataFrame(rows, f"{label} bigint, v string"))
        return self._shown(laid, [c for c in laid.columns if c != "v"])

    def dual_ray(self, name: str) -> DataFrame:
        """(dims..., value): weights of the rows that prove an infeasible model so."""
        if self.answer.ray is None:
            raise NoSolutionError(f"the solver stopped as {self.answer.status}, without a ray")
        laid = self._laid(name, self.handoff.constraints[name], "row", self._vector(self.answer.ray, "row"))
        return self._shown(laid, self.handoff.attached.program.constraints[name].dims)

    def to_pandas(self, name: str, kind: str = "primal"):
        """One table as a pandas frame, indexed by its dimensions."""
        made = (self.evaluate(name) if kind == "expression" else getattr(self, kind)(name)).toPandas()
        dims = [c for c in made.columns if c != "value"]
        return made.set_index(dims) if dims else made

    def to_dataarray(self, name: str, kind: str = "primal"):
        """One table as a labelled array; needs xarray."""
        import xarray  # noqa: F401  not installed everywhere

        return self.to_pandas(name, kind)["value"].to_xarray()

    @property
    def record(self) -> tuple:
        """How the solve ended, as a row of RECORD."""
        return (self.status, self.termination_condition, self.answer.objective, self.answer.x is not None, self.solved_at.replace(tzinfo=None), "rowloom")

    def metrics(self) -> DataFrame:
        """(metric, value) of the model and its solve."""
        facts = {"columns": self.handoff.n_cols, "rows": self.handoff.n_rows, **self.answer.facts} | ({} if self.answer.objective is None else {"objective": self.answer.objective})
        return self.handoff.attached.spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "metric string, value double")

    def tables(self, outputs: tuple[str, ...] = ()) -> dict[tuple[str, str], DataFrame]:
        """Every table of the answer, by kind and name; `outputs` adds kinds of OUTPUTS."""
        p = self.handoff.attached.program
        if unknown := [o for o in outputs if o not in OUTPUTS]:
            raise LanguageError(f"no output {unknown[0]}; there are {', '.join(OUTPUTS)}")
        made = {}
        if self.answer.x is not None:
            made |= {("primal", n): self.primal(n) for n in p.variables}
            if self.answer.y is not None:
                made |= {("dual", n): self.dual(n) for n in p.constraints}
            for n, e in p.expressions.items():
                if self.answer.y is not None or "dual" not in calls(e):
                    made["expression", n] = self.evaluate(n)
            for o in outputs:
                if o != "dual_ray":
                    made |= {(o, n): getattr(self, o)(n) for n in (p.variables if o in ("reduced_cost", "variable_basis") else p.constraints)}
        elif "dual_ray" in outputs and self.answer.ray is not None:
            made |= {("dual_ray", n): self.dual_ray(n) for n in p.constraints}
        return made

    def save(self, path: str, outputs: tuple[str, ...] = ()) -> str:
        """Write the answer as parquet, <path>/<kind>/<name>, and a record, which comes last and marks the whole."""
        spark = self.handoff.attached.spark
        for (kind, name), frame in self.tables(outputs).items():
            frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
        spark.createDataFrame([self.record], RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/record")
        return path


def slack_of(rows: DataFrame, activity: DataFrame) -> DataFrame:
    """(row, v): what each row leaves of its right side."""
    room = F.when(F.col("sense") == ">=", F.col("v") - F.col("rhs")).otherwise(F.col("rhs") - F.col("v"))
    return rows.join(activity, "row").select("row", room.alias("v"))


def reduced_costs(cols: DataFrame, obj: DataFrame, matrix: DataFrame, y: DataFrame) -> DataFrame:
    """(col, v): cost of every column less what its rows' duals pay for it."""
    paid = matrix.join(y, "row").select("col", (-F.col("coeff") * F.col("v")).alias("v"))
    every = obj.select("col", F.col("coeff").alias("v")).unionByName(paid).groupBy("col").agg(F.sum("v").alias("v"))
    return cols.select("col").join(every, "col", "left").select("col", F.coalesce("v", F.lit(0.0)).alias("v"))


def calls(node) -> set[str]:
    """Names of the operators in a tree."""
    if isinstance(node, Cases):
        return set().union(*(calls(e) for _, e in node.cases), calls(node.otherwise))
    inner = [*getattr(node, "args", ()), *(v for _, v in getattr(node, "kwargs", ())), *(getattr(node, s) for s in ("left", "right", "of") if hasattr(node, s))]
    return set().union({node.name} if isinstance(node, Call) else set(), *map(calls, inner))


@dataclass(frozen=True)
class Saved:
    """An answer read from where `Result.save` put it; its readers have the same names."""

    spark: SparkSession
    path: str

    def _read(self, kind: str, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{kind}/{name}")
        except AnalysisException as why:
            raise NoSolutionError(f"the saved answer has no {kind} of {name}") from why

    @property
    def record(self):
        try:
            return self.spark.read.parquet(f"{self.path}/record").first()
        except AnalysisException as why:
            raise LayoutError(f"{self.path} holds no whole answer") from why

    @property
    def status(self) -> str:
        return self.record["status"]

    @property
    def objective(self) -> float:
        if self.record["objective"] is None:
            raise NoSolutionError(f"the solver stopped as {self.record['termination_condition']}")
        return self.record["objective"]

    def __getattr__(self, kind: str):
        if kind in ("primal", "dual", "expression", *OUTPUTS):
            return lambda name: self._read(kind, name)
        raise AttributeError(kind)


def load_result(spark: SparkSession, path: str) -> Saved:
    """A saved answer, whole or refused."""
    found = Saved(spark, path)
    found.record  # noqa: B018  refuses an unfinished write
    return found


def scan_result(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    """One lazy table of a saved answer."""
    return load_result(spark, path)._read(kind, name)


class Model:
    """A built model: its tables, and what can be done with them."""

    def __init__(self, spark: SparkSession, spec, sources: dict):
        self.spark, self.spec, self.sources = spark, load(spec), dict(sources)
        self.update({})

    def update(self, sources: dict) -> Model:
        """Build again with some tables replaced."""
        self.close()
        self.sources |= sources
        began = time.monotonic()
        self.program = program(self.spec)
        attached = door.attach(self.spark, self.program, self.sources)
        between = time.monotonic()
        self.handoff = assemble(attached)
        self.seconds = {"attach": between - began, "build": time.monotonic() - between}
        return self

    def structure(self) -> str:
        """A digest that stays while an update brings new numbers only."""
        return structure(self.handoff)

    def check_sink(self, name: str) -> set[str]:
        """Constructs of the model that a sink (solver, lp, mps) can't take, by themselves or together."""
        return solver.refused(self.handoff.kinds) if name == "solver" else self.handoff.kinds - text.TEXT_TAKES[name]

    def solve(self, *, start: dict[str, DataFrame] | Result | None = None, outputs: tuple[str, ...] = (), save_to: str | None = None) -> Result:
        """`start`: an earlier result, or {variable: (dims..., value)}, matched by coordinate; what it lacks is unknown. `save_to` writes the answer, with `outputs`."""
        began = time.monotonic()
        result = Result(self.handoff, solver.solve(self.handoff, start=self._started(start) if "integrality" in self.handoff.kinds else None))
        self.seconds["solve"] = time.monotonic() - began
        if save_to is not None:
            result.save(save_to, outputs)
        return result

    def _started(self, start) -> np.ndarray | None:
        if start is None or isinstance(start, Result) and start.answer.x is None:
            return None
        given = {n: start.primal(n) for n in start.handoff.variables} if isinstance(start, Result) else start
        if unknown := [n for n in given if n not in self.program.variables]:
            raise LanguageError(f"start: no variable {unknown[0]}")
        out = np.full(self.handoff.n_cols, np.nan)
        for n, table in given.items():
            dims = [*self.program.variables[n].dims]
            labels = self.handoff.variables[n].select(*dims, "var")
            met = (labels.join(table, dims) if dims else labels.crossJoin(table)).select("var", "value").toPandas()
            out[met["var"].to_numpy(np.int64)] = met["value"]
        return out

    def write(self, path, *, single: bool = True) -> str:
        return text.write(self.handoff, path, single=single)

    def diagnostics(self) -> dict:
        return {"columns": self.handoff.n_cols, "rows": self.handoff.n_rows, "omitted": dict(self.handoff.omitted), "ranges": diagnostics(self.handoff), "sparse_parameters": sparse_parameters(self.handoff.attached), "seconds": dict(self.seconds)}

    def row(self, name: str, **coordinate) -> DataFrame:
        """One constraint row spelled out: (variable, dims as text, coeff), and its sense and right side."""
        h = self.handoff
        at = h.constraints[name]
        for d, label in coordinate.items():
            at = at.filter(F.col(d) == F.lit(label))
        entries = h.matrix.join(at.select("row"), "row").join(h.rows, "row")
        parts = []
        for v, frame in h.variables.items():
            dims = self.program.variables[v].dims
            where = F.concat_ws(", ", *[F.concat(F.lit(f"{d}="), F.col(d).cast("string")) for d in dims]) if dims else F.lit("")
            parts.append(frame.select(F.col("var").alias("col"), F.lit(v).alias("variable"), where.alias("coordinate")))
        named = parts[0]
        for p in parts[1:]:
            named = named.unionByName(p)
        return entries.join(named, "col").select("row", "variable", "coordinate", "coeff", "sense", "rhs").orderBy("row", "col")

    def infeasible_subsystem(self) -> DataFrame:
        """(constraint, coordinate, row): rows that can't hold together, and of which none can be spared."""
        wanted = self.spark.createDataFrame([(r,) for r in solver.infeasible_rows(self.handoff)], "row bigint")
        out = None
        for name, frame in self.handoff.constraints.items():
            dims = self.program.constraints[name].dims
            where = F.concat_ws(", ", *[F.concat(F.lit(f"{d}="), F.col(d).cast("string")) for d in dims]) if dims else F.lit("")
            part = frame.join(F.broadcast(wanted), "row").select(F.lit(name).alias("constraint"), where.alias("coordinate"), "row")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise NoSolutionError("the model has no rows")
        return out.orderBy("row")

    def close(self) -> None:
        """Let go of the label tables that the build kept."""
        for frame in [*getattr(self, "handoff", Handoff(None, "")).variables.values(), *getattr(self, "handoff", Handoff(None, "")).constraints.values()]:
            frame.unpersist()


def build(spark: SparkSession, spec, sources: dict) -> Model:
    return Model(spark, spec, sources)


def solve(spark: SparkSession, spec, sources: dict) -> Result:
    return build(spark, spec, sources).solve()


def write(spark: SparkSession, spec, sources: dict, path) -> str:
    return build(spark, spec, sources).write(path)
