"""Expressions and masks compiled to lazy DataFrames.

An expression is a list of terms: constants (dims..., v), linear terms
(dims..., var, v) and quadratic ones (dims..., var, var2, v). Adding concatenates
lists; products are joins on the shared dimensions; a sum of variables only drops
columns, because equal (row, column) pairs are added up once, in the matrix. A
coefficient that isn't there is a row that isn't there.

Presence is kept beside the terms: tables of coordinates outside which the
whole expression doesn't exist, as opposed to being zero. Operators that don't
map coordinates one to one restrict every term to it first.

A mask is the set of coordinates that it admits: comparison is a filter, AND a
join, OR a union, NOT an anti-join against the product. Nulls admit nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.errors import DataError, DimensionError, LanguageError, NoSolutionError
from rowloom.functions.formula import COMPARE, Binary, Call, Name, Num, Text, Unary
from rowloom.operators.ordinal import order_table, walk
from rowloom.plans.spec import Cases
from rowloom.sources.door import Attached

LABELS = {"const": (), "lin": ("var",), "quad": ("var", "var2")}


@dataclass(frozen=True)
class Term:
    kind: str
    dims: tuple[str, ...]
    frame: DataFrame
    plain: bool = False  # data as given: a coordinate without a row has no value
    names: tuple[str, ...] = ()
    full: bool = False  # a constant with a row at every coordinate of its dimensions
    whole: bool = False  # a variable with a row at every coordinate of its dimensions
    risky: bool = False  # a value may be null or infinite

    @property
    def labels(self) -> tuple[str, ...]:
        return LABELS[self.kind]


def negated(t: Term) -> Term:
    return replace(t, frame=t.frame.withColumn("v", -F.col("v")))


@dataclass
class Compiled:
    terms: list[Term] = field(default_factory=list)
    presences: list[tuple[DataFrame, tuple[str, ...]]] = field(default_factory=list)

    def of(self, kind: str) -> list[Term]:
        return [t for t in self.terms if t.kind == kind]


def compare(op: str, left, right):
    return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


class Compiler:
    """variables: (dims..., var) by name. values, duals: (dims..., v) by name, for reads at a solution."""

    def __init__(self, attached: Attached, variables: dict[str, DataFrame] | None = None, values: dict[str, DataFrame] | None = None, duals: dict[str, DataFrame] | None = None):
        self.a, self.p = attached, attached.program
        self.variables, self.values, self.duals = {} if variables is None else variables, values, duals

    # frames

    def join(self, left: DataFrame, right: DataFrame, shared, how: str = "inner") -> DataFrame:
        shared = list(shared)
        if shared:
            return left.join(right, shared, how)
        if how == "left_semi":
            return left.join(right.select(F.lit(True).alias("__any")).limit(1), F.lit(True), "left_semi")
        return left.crossJoin(right)

    def spread(self, t: Term, dims) -> Term:
        """The term repeated over the labels of dimensions that it lacks."""
        lacking = tuple(d for d in self.p.ordered(dims) if d not in t.dims)
        if not lacking:
            return t
        return replace(t, dims=self.p.ordered((*t.dims, *lacking)), frame=t.frame.crossJoin(self.a.product(lacking)), full=False)

    def within(self, frame: DataFrame, dims: tuple[str, ...], presences) -> DataFrame:
        for there, keys in presences:
            frame = self.join(frame, there, keys, "left_semi")
        return frame

    def settled(self, c: Compiled) -> list[Term]:
        """Every term restricted to where the whole expression exists."""
        keys = {k for _, ks in c.presences for k in ks}
        out = []
        for t in c.terms:
            s = self.spread(t, keys)
            out.append(replace(s, frame=self.within(s.frame, s.dims, c.presences), full=False, whole=s.whole and not c.presences))
        return out

    def filled(self, frame: DataFrame, dims: tuple[str, ...]) -> DataFrame:
        """Constants summed to one row per coordinate, zero where there is none."""
        summed = frame.groupBy(*dims).agg(F.sum("v").alias("v")) if dims else frame.agg(F.sum("v").alias("v"))
        return self.a.product(dims).join(summed, list(dims), "left").select(*dims, F.coalesce("v", F.lit(0.0)).alias("v")) if dims else summed.select(F.coalesce("v", F.lit(0.0)).alias("v"))

    def total(self, c: Compiled) -> Term:
        """All constants as one term. A single term stays as it is, gaps included."""
        terms = c.of("const")
        if len(terms) == 1:
            return terms[0]
        dims = self.p.ordered({d for t in terms for d in t.dims} | {k for _, ks in c.presences for k in ks})
        frame = self.within(self.a.product(dims), dims, c.presences)
        return Term("const", dims, self.added(frame, dims, terms).select(*dims, "v"), full=not c.presences, risky=any(t.risky for t in terms))

    def added(self, carrier: DataFrame, dims: tuple[str, ...], terms: list[Term]) -> DataFrame:
        """The carrier with v, the sum of the constants; a gap adds nothing."""
        columns = []
        for i, t in enumerate(terms):
            own = t.frame.select(*t.dims, F.col("v").alias(f"__v{i}"), F.lit(True).alias(f"__in{i}"))
            carrier = carrier.join(own, list(t.dims), "left") if t.dims else carrier.crossJoin(own)
            # a row with a null value is a missing divisor: it spoils the sum, a missing row doesn't
            columns.append(F.when(F.col(f"__in{i}").isNull(), F.lit(0.0)).otherwise(F.col(f"__v{i}")))
        v = reduce(lambda x, y: x + y, columns, F.lit(0.0))
        return carrier.withColumn("v", v).drop(*[c for i in range(len(terms)) for c in (f"__v{i}", f"__in{i}")])

    # expressions

    def expression(self, node) -> Compiled:
        match node:
            case None:
                return self.number(0.0)
            case Num(x):
                return self.number(float(x))
            case Cases():
                return self.cases(node)
            case Name(n) if n in self.p.parameters:
                return self.parameter(n)
            case Name(n) if n in self.p.variables:
                return self.variable(n)
            case Name(n) if n in self.p.expressions:
                return self.expression(self.p.expressions[n])
            case Name("inf"):
                return self.number(float("inf"))
            case Name(n) if n in self.p.dimensions and self.p.dimensions[n].dtype in ("int", "float"):
                return Compiled([Term("const", (n,), self.a.dimension(n).select(n, F.col(n).cast("double").alias("v")), True)])
            case Unary("-", of):
                c = self.expression(of)
                return Compiled([negated(t) for t in c.terms], c.presences)
            case Binary("+", x, y):
                c, d = self.expression(x), self.expression(y)
                return Compiled(c.terms + d.terms, c.presences + d.presences)
            case Binary("-", x, y):
                return self.expression(Binary("+", x, Unary("-", y)))
            case Binary("*", x, y):
                return self.product(self.expression(x), self.expression(y))
            case Binary("/", x, Num(n)) if n:
                c = self.expression(x)
                return Compiled([replace(t, frame=t.frame.withColumn("v", F.col("v") / F.lit(float(n))), plain=False) for t in c.terms], c.presences)
            case Binary("/", x, y):
                return self.quotient(self.expression(x), self.expression(y))
            case Binary("**", x, y):
                c, d = self.expression(x), self.expression(y)
                s, t = self.total(c), self.total(d)
                frame = self.join(s.frame, t.frame.withColumnRenamed("v", "__e"), set(s.dims) & set(t.dims))
                dims = self.p.ordered((*s.dims, *t.dims))
                return Compiled([Term("const", dims, frame.select(*dims, F.pow("v", "__e").alias("v")), risky=True)], c.presences + d.presences)
            case Call("sum", (e,)):
                return self.summed(node, e)
            case Call("at", (e,)):
                return self.pulled(node, e)
            case Call("shift", (e,)):
                return self.shifted(node, e)
            case Call("sum_back", (e,)):
                return self.trailing(node, e)
            case Call("dual", (Name(n),)):
                if self.duals is None or n not in self.duals:
                    raise NoSolutionError(f"dual({n}): there is no solution with duals to read")
                dims = self.p.constraints[n].dims
                return Compiled([Term("const", dims, self.duals[n].select(*dims, "v"), True)], [(self.duals[n].select(*dims), dims)])
        raise LanguageError(f"{node} isn't an expression")

    def number(self, x: float) -> Compiled:
        return Compiled([Term("const", (), self.a.one_row().select(F.lit(x).alias("v")), full=True, risky=x in (float("inf"), float("-inf")))])

    def parameter(self, n: str) -> Compiled:
        p, table = self.p.parameters[n], self.a.parameters[n]
        if p.dtype == "str":
            raise LanguageError(f"parameter {n} holds text; it can be compared, not computed with")
        there = [(table.select(*p.dims), p.dims)] if p.missing == "absent" and p.dims else []
        return Compiled([Term("const", p.dims, table.select(*p.dims, F.col("value").cast("double").alias("v")), True, (n,), p.missing not in ("neutral", "absent"), risky=n not in self.a.finite)], there)

    def variable(self, n: str) -> Compiled:
        v = self.p.variables[n]
        if self.values is None:
            frame, kind = self.variables[n].select(*v.dims, "var", F.lit(1.0).alias("v")), "lin"
        else:
            frame, kind = self.values[n].select(*v.dims, "v"), "const"
            if v.missing == "neutral" and v.dims:
                frame = self.filled(frame, v.dims)
        there = [(frame.select(*v.dims), v.dims)] if v.missing == "absent" and v.where is not None and v.dims else []
        return Compiled([Term(kind, v.dims, frame, kind == "const", (n,) if kind == "const" else (), whole=kind == "lin" and v.where is None)], there)

    def pair(self, s: Term, t: Term) -> Term:
        kind = {0: "const", 1: "lin", 2: "quad"}[len(s.labels) + len(t.labels)]
        renamed = t.frame.withColumnRenamed("v", "__w")
        if s.kind == t.kind == "lin":
            renamed = renamed.withColumnRenamed("var", "var2")
        dims = self.p.ordered((*s.dims, *t.dims))
        frame = self.join(s.frame, renamed, set(s.dims) & set(t.dims))
        covers = lambda x: x.whole if x.labels else x.full
        both = covers(s) and covers(t)
        return Term(kind, dims, frame.select(*dims, *LABELS[kind], (F.col("v") * F.col("__w")).alias("v")), False, s.names + t.names, both and kind == "const", both and kind != "const", s.risky or t.risky)

    def product(self, c: Compiled, d: Compiled) -> Compiled:
        one = lambda x: [self.total(x)] if len(x.of("const")) == len(x.terms) else x.terms
        return Compiled([self.pair(s, t) for s in one(c) for t in one(d)], c.presences + d.presences)

    def quotient(self, c: Compiled, d: Compiled) -> Compiled:
        """Missing divisors give null and zero ones infinity, which a build refuses; at a read a zero divisor makes the quotient absent."""
        t = self.total(d)
        divisor, out = t.frame.withColumnRenamed("v", "__d"), []
        for s in ([self.total(c)] if not c.of("lin") and not c.of("quad") else c.terms):
            s = self.spread(s, t.dims)
            frame = s.frame.join(divisor, list(t.dims), "left") if t.dims else s.frame.crossJoin(divisor)
            v = F.when(F.col("__d").isNull(), F.lit(None).cast("double")).when(F.col("__d") == 0, F.lit(float("inf"))).otherwise(F.try_divide("v", "__d"))
            out.append(Term(s.kind, s.dims, frame.select(*s.dims, *s.labels, v.alias("v")), False, s.names + t.names, risky=True))
        there = [(t.frame.filter("v <> 0").select(*t.dims), t.dims)] if self.values is not None and t.dims else []
        return Compiled(out, c.presences + d.presences + there)

    def summed(self, node: Call, e) -> Compiled:
        c, over, by = self.expression(e), self.p.over(node, e), node.get("by")
        added, columns = {}, ()
        if by is not None:
            r, columns = self.p.relation(by)
            from_ = [x for x in r.columns if x not in columns]
            joined = {x: r.columns[x] for x in from_ if r.columns[x] in over}
            if {*joined.values()} != {*over}:
                raise DimensionError(f"sum(): {r.name} doesn't lead from {', '.join(over)} to {', '.join(columns)}")
            added = {x: r.columns[x] for x in columns}
            table = self.a.relations[r.name].select(*[F.col(x).alias(d) for x, d in joined.items()], *[F.col(x).alias(f"__to_{d}") for x, d in added.items()])
            if not set(r.key or r.columns) <= {*joined, *added}:  # a key that is there whole has one row anyway
                table = table.distinct()
        out = []
        for t in self.settled(c):
            if lacking := [d for d in over if d not in t.dims]:
                if t.kind == "const":
                    raise DimensionError(f"sum(): a constant has no dimension {', '.join(lacking)} to sum over")
                t = self.spread(t, over)
            keep = [d for d in t.dims if d not in over]
            dims = self.p.ordered((*keep, *added.values()))
            frame = t.frame
            if by is not None:
                frame = frame.join(table, list(over))
                frame = frame.select(*keep, *[F.col(f"__to_{d}").alias(d) for d in added.values()], *t.labels, "v")
            frame = frame.select(*dims, *t.labels, "v")
            kept = t.whole and by is None and all(self.a.sizes[d] for d in over)
            out.append(Term(t.kind, dims, self.filled(frame, dims) if t.kind == "const" else frame, False, t.names, t.kind == "const", kept, t.risky))
        return Compiled(out)

    def relation_walk(self, by) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
        """A relation with landed columns as __at_<dimension> and its fine columns under their dimension."""
        r, columns = self.p.relation(by)
        fine = {x: r.columns[x] for x in self.p.spread(r, columns)}
        landed = {x: r.columns[x] for x in columns}
        return self.a.relations[r.name].select(*[F.col(x).alias(f"__at_{d}") for x, d in landed.items()], *[F.col(x).alias(d) for x, d in fine.items()]), landed, fine

    def pull(self, frame: DataFrame, dims: tuple[str, ...], by) -> tuple[DataFrame, tuple[str, ...]]:
        table, landed, fine = self.relation_walk(by)
        rest = [d for d in dims if d not in landed.values()]
        renamed = frame
        for d in landed.values():
            renamed = renamed.withColumnRenamed(d, f"__at_{d}")
        shared = [f"__at_{d}" for d in landed.values()] + [d for d in fine.values() if d in rest]
        moved = renamed.join(table, shared).drop(*[f"__at_{d}" for d in landed.values()])
        return moved, self.p.ordered((*rest, *fine.values()))

    def pulled(self, node: Call, e) -> Compiled:
        c, by = self.expression(e), node.get("by")
        table, _, fine = self.relation_walk(by)
        there = [(table.select(*fine.values()).distinct(), tuple(fine.values()))]  # a label without a row in the relation has no value
        for frame, keys in c.presences:
            there.append(self.pull(self.spread(Term("const", keys, frame), self.landed(by)).frame, self.p.ordered((*keys, *self.landed(by))), by))
        out = []
        for t in c.terms:
            if not set(self.landed(by)) & set(t.dims):
                out.append(t)
                continue
            frame, dims = self.pull(self.spread(t, self.landed(by)).frame, self.p.ordered((*t.dims, *self.landed(by))), by)
            out.append(Term(t.kind, dims, frame, t.plain, t.names, risky=t.risky))
            if t.plain:  # a read that finds no row is absent
                there.append((frame.select(*dims), dims))
        return Compiled(out, there)

    def landed(self, by) -> tuple[str, ...]:
        r, columns = self.p.relation(by)
        return tuple(r.columns[c] for c in columns)

    def orders(self, node: Call, along: str) -> tuple[DataFrame, dict[str, str]]:
        """The ordinal table of a walk, and group column -> dimension."""
        within = node.get("within")
        if within is None:
            return order_table(self.a.dimension(along), along), {}
        r, columns = self.p.relation(within)
        member = next(x for x, d in r.columns.items() if d == along and x not in columns)
        return order_table(self.a.dimension(along), along, self.a.relations[r.name], columns, member), {f"g_{i}": r.columns[x] for i, x in enumerate(columns)}

    def amount(self, frame: DataFrame, dims: tuple[str, ...], amount, groups: dict[str, str], orders: DataFrame, along: str) -> tuple[DataFrame, tuple[str, ...], object]:
        """The frame with a step column where the amount is a parameter."""
        if isinstance(amount, Num) or isinstance(amount, Unary):
            return frame, dims, F.lit(int(amount.value if isinstance(amount, Num) else -amount.of.value))
        p = self.p.parameters[amount.name]
        if p.dtype != "int":
            raise LanguageError(f"{amount.name} must be an int parameter to walk by")
        table = self.a.parameters[amount.name].withColumnRenamed("value", "__by")
        grouped = {d: g for g, d in groups.items() if d in p.dims and d not in dims}
        if grouped:  # the group's own amount
            table = orders.select(along, *grouped.values()).join(table.select(*[F.col(d).alias(grouped.get(d, d)) for d in p.dims], "__by"), [*grouped.values()]).drop(*grouped.values())
        extra = tuple(d for d in p.dims if d not in dims and d not in grouped)
        if extra:
            frame, dims = frame.crossJoin(self.a.product(extra)), self.p.ordered((*dims, *extra))
        shared = [d for d in table.columns if d != "__by"]
        return self.join(frame, table, shared), dims, F.col("__by")

    def stepped(self, node: Call, frame: DataFrame, dims: tuple[str, ...], along: str, columns: list[str], many: bool = False) -> tuple[DataFrame, tuple[str, ...]]:
        orders, groups = self.orders(node, along)
        amount = node.get("window" if many else "offset")
        frame, dims, lag = self.amount(frame, dims, amount, groups, orders, along)
        size = F.col("size") if groups else F.lit(self.a.sizes[along])
        wrap = node.get("edge") == Text("wrap")
        if many:
            width = F.least(lag.cast("bigint"), size.cast("bigint"))
            lag = F.when(width > 0, F.sequence(F.lit(0).cast("bigint"), width - 1))
        moved = walk(frame, orders, along, lag, size, wrap, many)
        return moved.select(*dims, *columns), dims

    def shifted(self, node: Call, e) -> Compiled:
        c, along, edge = self.expression(e), self.p.along(node, e), node.get("edge")
        out, there = [], []
        for t in c.terms:
            t = self.spread(t, (along,)) if t.kind != "const" or along in t.dims else self._lacks(node, along)
            frame, dims = self.stepped(node, t.frame, t.dims, along, [*t.labels, "v"])
            out.append(Term(t.kind, dims, frame, t.plain, t.names, whole=t.whole and edge == Text("wrap") and node.get("within") is None and dims == t.dims, risky=t.risky))
        every = self.a.dimension(along).select(along)
        source, source_dims = self.stepped(node, every, (along,), along, [])  # where a walk can come from
        ungrouped = (self.orders(node, along)[0].select(along), (along,)) if node.get("within") is not None else None
        moved = []
        for frame, keys in c.presences:
            s = self.spread(Term("const", keys, frame), (along,))
            moved.append(self.stepped(node, s.frame, s.dims, along, []))
        if edge is None:
            there = [*moved, (source, source_dims)]
        elif edge == Text("wrap"):
            there = moved + ([ungrouped] if ungrouped else [])
        else:
            value = edge.value if isinstance(edge, Num) else -edge.of.value
            vacated = self.a.product(source_dims).join(source, list(source_dims), "left_anti")
            if ungrouped:
                vacated = vacated.join(ungrouped[0], along, "left_semi")
                there.append(ungrouped)
            for frame, keys in moved:
                rest = [d for d in keys if d not in source_dims]
                lines = frame.select(*rest).distinct() if rest else None
                filled = vacated if lines is None else vacated.crossJoin(lines)
                there.append((frame.unionByName(filled.select(*keys)) if set(source_dims) <= set(keys) else frame, keys))
            if value:
                others = tuple(d for d in self.p.ordered({x for t in out for x in t.dims}) if d not in source_dims)
                dims = self.p.ordered((*source_dims, *others))
                spread = vacated.crossJoin(self.a.product(others)) if others else vacated
                out.append(Term("const", dims, spread.select(*dims, F.lit(float(value)).alias("v")), False))
            out = [replace(t, plain=False) for t in out]
        return Compiled(out, there)

    def _lacks(self, node: Call, along: str):
        raise DimensionError(f"{node.name}(): a constant has no dimension {along} to walk along")

    def trailing(self, node: Call, e) -> Compiled:
        """Trailing sums: a row at o lands at o, o + 1, ... within its window; equal landings add up later."""
        c, along, out = self.expression(e), self.p.along(node, e), []
        for t in self.settled(c):
            t = self.spread(t, (along,)) if t.kind != "const" or along in t.dims else self._lacks(node, along)
            frame, dims = self.stepped(node, t.frame, t.dims, along, [*t.labels, "v"], many=True)
            out.append(Term(t.kind, dims, self.filled(frame, dims) if t.kind == "const" else frame, False, t.names, risky=t.risky))
        there = [(self.orders(node, along)[0].select(along), (along,))] if node.get("within") is not None else []
        return Compiled(out, there)

    def cases(self, node: Cases) -> Compiled:
        terms, presences, before = [], [], None
        regions = [(m, e) for m, e in node.cases] + ([(None, node.otherwise)] if node.otherwise is not None else [])
        all_dims = self.p.ordered({d for m, _ in node.cases for d in self.p.dims(m)})
        for mask, e in regions:
            if mask is not None:
                keys = self.p.dims(mask)
                inside = self.admitted(mask)
                wide = inside if keys == all_dims else inside.crossJoin(self.a.product(tuple(d for d in all_dims if d not in keys)))
                wide = wide.select(*all_dims)
                before = wide if before is None else before.unionByName(wide)
            else:
                keys, inside = all_dims, self.a.product(all_dims).join(before, list(all_dims), "left_anti")
            c = self.expression(e)
            for t in c.terms:
                s = self.spread(t, keys)
                terms.append(Term(s.kind, s.dims, self.join(s.frame, inside, keys, "left_semi"), False, t.names, risky=t.risky))
            for frame, ks in c.presences:
                dims = self.p.ordered((*ks, *keys))
                product = self.a.product(dims)
                gone = self.join(product, inside, keys, "left_semi").join(frame, list(ks), "left_anti")
                presences.append((product.join(gone, list(dims), "left_anti"), dims))
        if node.otherwise is None and before is not None:
            presences.append((before.distinct(), all_dims))
        return Compiled(terms, presences)

    # reads

    def value(self, node) -> tuple[DataFrame, tuple[str, ...]]:
        """(dims..., v) of a variable-free expression, where it exists."""
        c = self.expression(node)
        dims = self.p.ordered({*self.p.dims(node), *(d for t in c.terms for d in t.dims), *(k for _, ks in c.presences for k in ks)})
        if len(c.terms) == 1 and c.terms[0].full and c.terms[0].dims == dims and not c.presences:
            return c.terms[0].frame.select(*dims, "v"), dims
        carrier = self.within(self.a.product(dims), dims, c.presences)
        return self.added(carrier, dims, c.of("const")).select(*dims, "v"), dims

    # masks

    def admitted(self, node) -> DataFrame:
        """Coordinates, over the dimensions that the mask reads, where it holds; each once."""
        dims = self.p.dims(node)
        match node:
            case Name("true"):
                return self.a.one_row()
            case Name("false"):
                return self.a.one_row().filter(F.lit(False))
            case Binary("and", x, y):
                left, right = self.p.dims(x), self.p.dims(y)
                return self.join(self.admitted(x), self.admitted(y), set(left) & set(right)).select(*dims)
            case Binary("or", x, y):
                sides = [self.wide(s, dims) for s in (x, y)]
                return sides[0].unionByName(sides[1]).distinct() if dims else sides[0].union(sides[1]).limit(1)
            case Unary("not", of):
                return self.a.product(dims).join(self.admitted(of), list(dims), "left_anti") if dims else self.a.one_row().join(self.admitted(of), F.lit(True), "left_anti")
            case Name(n) if n in self.p.conditions:
                return self.admitted(self.p.conditions[n])
            case Name(n) if n in self.p.parameters:
                return self.defined(n)
            case Name(n) if n in self.p.relations:
                r = self.p.relations[n]
                return self.a.relations[n].select(*[F.col(c).alias(r.columns[c]) for c in (r.key or r.columns)]).distinct()
            case Name(n) if n in self.p.variables:
                return (self.variables if self.values is None else self.values)[n].select(*dims)
            case Call("at", (e,)):
                return self.pull(self.admitted(e), self.p.dims(e), node.get("by"))[0].select(*dims).distinct()
            case Call("shift", (e,)):
                return self.stepped(node, self.admitted(e), self.p.dims(e), self.p.along(node, e), [])[0].select(*dims)
            case Binary(op, x, y) if op in COMPARE:
                return self.compared(op, x, y, dims)
        raise LanguageError(f"{node} isn't a mask")

    def wide(self, node, dims: tuple[str, ...]) -> DataFrame:
        own = self.p.dims(node)
        rest = tuple(d for d in dims if d not in own)
        found = self.admitted(node)
        return (found.crossJoin(self.a.product(rest)) if rest else found).select(*dims)

    def masked(self, dims: tuple[str, ...], node, ords: bool = False) -> DataFrame:
        """The product of the dimensions where the mask holds: one semi-join per conjunct, on the dimensions that it reads."""
        frame = self.a.product(dims, ords)
        stack = [] if node is None else [node]
        while stack:
            n = stack.pop()
            if isinstance(n, Binary) and n.op == "and":
                stack += [n.left, n.right]
            else:
                frame = self.join(frame, self.admitted(n), self.p.dims(n), "left_semi")
        return frame

    def defined(self, n: str) -> DataFrame:
        p, table = self.p.parameters[n], self.a.parameters[n]
        there = {"bool": F.col("value"), "str": F.lit(True)}.get(p.dtype, (F.abs("value") < float("inf")) if p.dtype == "float" else F.lit(True))
        found = table.filter(there).select(*p.dims)
        return found.join(self.a.given[n].select(*p.dims), list(p.dims), "left_semi") if n in self.a.given and p.dims and p.dtype != "bool" else found

    def compared(self, op: str, x, y, dims: tuple[str, ...]) -> DataFrame:
        flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        literal = lambda n: n.value if isinstance(n, (Num, Text)) else -n.of.value if isinstance(n, Unary) and isinstance(n.of, Num) else n.name if isinstance(n, Name) and not self.p.knows(n.name) else None
        if literal(x) is not None and literal(y) is None:
            x, y, op = y, x, flip
        value = literal(y)
        if isinstance(x, Call) and x.name == "count":
            e = x.args[0]
            rest = dims
            counted = self.admitted(e).groupBy(*rest).agg(F.count("*").alias("n")) if rest else self.admitted(e).agg(F.count("*").alias("n"))
            counted = self.a.product(rest).join(counted, list(rest), "left").select(*rest, F.coalesce("n", F.lit(0)).alias("n")) if rest else counted
            return counted.filter(compare(op, F.col("n"), F.lit(value))).select(*rest)
        if isinstance(x, Call) and x.name == "position":
            return self.position(x, op, int(value))
        if isinstance(x, Name) and value is not None:
            if x.name in self.p.parameters:
                return self.a.parameters[x.name].filter(compare(op, F.col("value"), F.lit(value))).select(*dims)
            if x.name in self.p.dimensions:
                return self.a.dimension(x.name).filter(compare(op, F.col(x.name), F.lit(value).cast(self.a.dimensions[x.name].schema[x.name].dataType))).select(x.name)
            if x.name in self.p.relations:
                r = self.p.relations[x.name]
                held = next(c for c in r.columns if c not in r.key)
                return self.a.relations[x.name].filter(compare(op, F.col(held), F.lit(value))).select(*[F.col(c).alias(r.columns[c]) for c in r.key])
        if isinstance(x, Name) and isinstance(y, Name) and x.name in self.p.relations:
            return self.related(op, x.name, y.name)
        left, ld = self.value_or_gap(x)
        right, rd = self.value_or_gap(y)
        both = self.join(left, right.withColumnRenamed("v", "__w"), set(ld) & set(rd))
        return both.filter(compare(op, F.col("v"), F.col("__w"))).select(*dims)

    def value_or_gap(self, node) -> tuple[DataFrame, tuple[str, ...]]:
        """A side of a comparison: a single parameter has no value where it has no row."""
        c = self.expression(node)
        if len(c.terms) == 1 and c.terms[0].kind == "const":
            t = c.terms[0]
            return self.within(t.frame, t.dims, [(f, k) for f, k in c.presences if set(k) <= set(t.dims)]), t.dims
        return self.value(node)

    def related(self, op: str, n: str, m: str) -> DataFrame:
        r, table = self.p.relations[n], self.a.relations[n]
        held = next(c for c in r.columns if c not in r.key)
        keys = [F.col(c).alias(r.columns[c]) for c in r.key]
        if m in self.p.relations:
            s = self.p.relations[m]
            other = next(c for c in s.columns if c not in s.key)
            right = self.a.relations[m].select(*[F.col(c).alias(s.columns[c]) for c in s.key], F.col(other).alias("__w"))
            shared = [r.columns[c] for c in r.key if r.columns[c] in {s.columns[k] for k in s.key}]
            both = self.join(table.select(*keys, F.col(held).alias("__v")), right, shared)
            dims = self.p.ordered({*(r.columns[c] for c in r.key), *(s.columns[c] for c in s.key)})
        else:  # against a dimension's own labels
            both = table.select(*keys, F.col(held).alias("__v")).join(self.a.dimension(m).select(F.col(m), F.col(m).alias("__w")), compare(op, F.col("__v"), F.col("__w")))
            dims = self.p.ordered({*(r.columns[c] for c in r.key), m})
        return both.filter(compare(op, F.col("__v"), F.col("__w"))).select(*dims)

    def position(self, node: Call, op: str, wanted: int) -> DataFrame:
        d = node.args[0].name
        if node.get("within") is None:
            size = self.a.sizes[d]
            if op == "==" and not -size <= wanted < size:
                raise DataError(f"position({d}) == {wanted}: there are {size} labels")
            at = wanted if wanted >= 0 else size + wanted
            return self.a.dimension(d).filter(compare(op, F.col("ord"), F.lit(at))).select(d)
        orders, _ = self.orders(node, d)
        need = wanted + 1 if wanted >= 0 else -wanted
        if op == "==" and (short := orders.filter(F.col("size") < need).limit(1).collect()):
            raise DataError(f"position({d}) == {wanted}: a group has {short[0]['size']} labels")
        return orders.filter(compare(op, F.col("o"), F.lit(wanted) if wanted >= 0 else F.col("size") + wanted)).select(d)


RANGES = 1024


def dealt(frame: DataFrame, position: str, size: int) -> DataFrame:
    """Rows with the equal range of 0..size-1 that their position is in."""
    return frame.withColumn("__range", F.floor(F.col(position) / max(1, -(-size // RANGES))).cast("bigint"))


def range_counts(frame: DataFrame, position: str, size: int) -> dict[int, int]:
    """Rows in each of at most RANGES equal ranges of a position; all that the driver sees of a labelling."""
    return {r[0]: r[1] for r in dealt(frame, position, size).groupBy("__range").count().collect()}


def ranked(frame: DataFrame, position: str, label: str, size: int, counts: dict[int, int], start: int = 0) -> DataFrame:
    """Rows numbered from `start` in the order of a distinct position in 0..size-1.

    A row's number is what lies before its range and its rank in it, so no
    window covers more than one range.
    """
    before, total = [], start
    for k in sorted(counts):
        before.append((k, total))
        total += counts[k]
    small = frame.sparkSession.createDataFrame(pa.table({"__range": pa.array([k for k, _ in before], pa.int64()), "__before": pa.array([n for _, n in before], pa.int64())}))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(position)) - 1
    return dealt(frame, position, size).join(F.broadcast(small), "__range").withColumn(label, (F.col("__before") + rank).cast("bigint")).drop("__range", "__before")
