"""A specification read into checked declarations, with macros and named expressions expanded."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from difflib import get_close_matches
from pathlib import Path

from rowloom.errors import DimensionError, LanguageError, SchemaError
from rowloom.functions.formula import COMPARE, Binary, Call, Many, Name, Num, Pick, Text, Unary, parse, replace

SECTIONS = ("version", "description", "dimensions", "relations", "parameters", "variables", "constraints", "objective", "expressions", "macros", "conditions", "assumptions", "sos", "piecewise", "given", "notation")
OPERATORS = ("sum", "at", "shift", "sum_back", "dual")
DTYPES = ("int", "float", "str", "datetime", "bool")


@dataclass(frozen=True)
class Dimension:
    name: str
    dtype: str = "str"
    ordered: bool = False


@dataclass(frozen=True)
class Relation:
    """columns: column -> dimension. key is empty for a bare relation: all columns together are its key."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    missing: str = "refused"


@dataclass(frozen=True)
class Parameter:
    name: str
    dims: tuple[str, ...] = ()
    dtype: str = "float"
    missing: object = "refused"


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...] = ()
    where: object = None
    lower: object = None
    upper: object = None
    domain: str = "continuous"
    missing: str = "absent"


@dataclass(frozen=True)
class Constraint:
    name: str
    dims: tuple[str, ...]
    left: object
    sense: str
    right: object
    where: object = None


@dataclass(frozen=True)
class Cases:
    """Regions with their own expressions; `otherwise` holds outside all of them."""

    cases: tuple  # (mask, expression) pairs
    otherwise: object = None


@dataclass(frozen=True)
class Sos:
    name: str
    variable: str
    along: str
    kind: int


@dataclass
class Program:
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    parameters: dict[str, Parameter] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    constraints: dict[str, Constraint] = field(default_factory=dict)
    expressions: dict[str, object] = field(default_factory=dict)
    conditions: dict[str, object] = field(default_factory=dict)
    assumptions: dict[str, tuple] = field(default_factory=dict)
    sos: dict[str, Sos] = field(default_factory=dict)
    sense: str = "minimize"
    objective: object = None
    curves: list[tuple] = field(default_factory=list)  # (name, over, x, y, sense): convex, or concave for <=

    # dimensions of a tree, in the order of declaration

    def ordered(self, dims) -> tuple[str, ...]:
        return tuple(d for d in self.dimensions if d in set(dims))

    def knows(self, name: str) -> bool:
        return any(name in x for x in (self.parameters, self.variables, self.dimensions, self.relations, self.expressions, self.conditions))

    def relation(self, node) -> tuple[Relation, tuple[str, ...]]:
        if not isinstance(node, Pick) or node.relation not in self.relations:
            raise LanguageError(f"by= takes relation[column]; {node} isn't one")
        r = self.relations[node.relation]
        for c in node.columns:
            if c not in r.columns:
                raise SchemaError(f"relation {r.name} has no column {c}; it has {', '.join(r.columns)}")
        return r, node.columns

    def dims(self, node) -> tuple[str, ...]:
        match node:
            case None | Num() | Text():
                return ()
            case Cases(cases, otherwise):
                return self.ordered({d for m, e in cases for d in (*self.dims(m), *self.dims(e))} | set(self.dims(otherwise)))
            case Name(n):
                if n in ("true", "false"):
                    return ()
                if n in self.parameters:
                    return self.parameters[n].dims
                if n in self.variables:
                    return self.variables[n].dims
                if n in self.dimensions:
                    return (n,)
                if n in self.expressions:
                    return self.dims(self.expressions[n])
                if n in self.conditions:
                    return self.dims(self.conditions[n])
                if n in self.relations:
                    r = self.relations[n]
                    return self.ordered(r.columns[c] for c in (r.key or tuple(r.columns)))
                raise SchemaError(f"unknown name {n}" + self.hint(n))
            case Unary(_, of):
                return self.dims(of)
            case Binary(op, Name(n), Name(label)) if op in COMPARE and (n in self.dimensions or n in self.relations) and not self.knows(label):
                return self.dims(Name(n))
            case Binary(_, a, b):
                return self.ordered((*self.dims(a), *self.dims(b)))
            case Call("sum", (e,)):
                over, own = self.over(node, e), self.dims(e)
                by = node.get("by")
                added = [self.relations[by.relation].columns[c] for c in self.relation(by)[1]] if by is not None else []
                return self.ordered([*(d for d in own if d not in over), *added])
            case Call("at", (e,)):
                r, columns = self.relation(node.get("by"))
                landed = {r.columns[c] for c in columns}
                if not landed <= set(self.dims(e)):
                    raise DimensionError(f"at(): the operand has no dimension {', '.join(sorted(landed - set(self.dims(e))))}")
                return self.ordered([*(d for d in self.dims(e) if d not in landed), *(r.columns[c] for c in self.spread(r, columns))])
            case Call("shift" | "sum_back", (e,)):
                along = self.along(node, e)
                amount = node.get("offset") or node.get("window")
                extra = [d for d in self.dims(amount) if d != along] if isinstance(amount, Name) else []
                within = node.get("within")
                grouped = {self.relations[within.relation].columns[c] for c in within.columns} if within is not None else set()
                return self.ordered([*self.dims(e), *(d for d in extra if d not in grouped)])
            case Call("count", (e,)):
                over = self.over(node, e)
                return self.ordered(d for d in self.dims(e) if d not in over)
            case Call("position", (Name(d),)):
                return (d,)
            case Call("dual", (Name(c),)):
                return self.constraints[c].dims
        raise LanguageError(f"can't tell the dimensions of {node}")

    def spread(self, r: Relation, landed: tuple[str, ...]) -> tuple[str, ...]:
        return r.key or tuple(c for c in r.columns if c not in landed)

    def over(self, node: Call, e) -> tuple[str, ...]:
        given = node.get("over")
        if given is None:
            return self.dims(e)
        over = tuple(n.name for n in (given.items if isinstance(given, Many) else (given,)))
        for d in over:
            if d not in self.dims(e):
                raise DimensionError(f"{node.name}(): the operand has no dimension {d}")
        return over

    def along(self, node: Call, e) -> str:
        along = node.get("along")
        if not isinstance(along, Name) or along.name not in self.dims(e):
            raise DimensionError(f"{node.name}(): along= must name a dimension of the operand")
        if not self.dimensions[along.name].ordered:
            raise SchemaError(f"{node.name}() walks along {along.name}, which isn't ordered")
        return along.name

    def degree(self, node) -> int:
        """Greatest number of variables in a product; over 2, or a variable where none may be, is refused."""
        match node:
            case Name(n):
                return 1 if n in self.variables else self.degree(self.expressions[n]) if n in self.expressions else 0
            case Unary("-", of):
                return self.degree(of)
            case Cases(cases, otherwise):
                return max([self.degree(e) for _, e in cases] + [self.degree(otherwise)])
            case Binary("+" | "-", a, b):
                return max(self.degree(a), self.degree(b))
            case Binary("*", a, b):
                total = self.degree(a) + self.degree(b)
                if total > 2:
                    raise LanguageError("a product of more than two variables")
                return total
            case Binary("/" | "**", a, b):
                if self.degree(b) or node.op == "**" and self.degree(a):
                    raise LanguageError(f"a variable where {node.op} takes data only")
                return self.degree(a)
            case Call(name, args):
                if name not in OPERATORS:
                    raise LanguageError(f"no operator {name}; there are {', '.join(OPERATORS)}" + self.hint(name, OPERATORS))
                return 0 if name == "dual" else self.degree(args[0]) if args else 0
        return 0

    def hint(self, name: str, known=None) -> str:
        near = get_close_matches(name, known or [*self.dimensions, *self.parameters, *self.variables, *self.relations, *self.expressions, *self.conditions], 1)
        return f"; did you mean {near[0]}?" if near else ""


def _listed(value) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value or ())


def _expand(node, macros: dict, depth: int = 0):
    """Macro calls replaced by their templates."""
    if depth > 50:
        raise LanguageError("macros call each other without end")
    match node:
        case Call(n, args, kwargs) if n in macros:
            m = macros[n]
            want, keys = _listed(m.get("args")), m.get("kwargs") or ()
            keys = dict(keys) if isinstance(keys, dict) else dict.fromkeys(_listed(keys))
            if len(args) != len(want) or not {k for k, _ in kwargs} <= set(keys):
                raise LanguageError(f"macro {n} takes {', '.join((*want, *(f'{k}=' for k in keys)))}")
            given = {k: parse(v) for k, v in keys.items() if v is not None} | dict(zip(want, args, strict=True)) | dict(kwargs)
            if missing := [k for k in keys if k not in given]:
                raise LanguageError(f"macro {n} needs {', '.join(missing)}=")
            return _expand(replace(parse(m["template"]), given), macros, depth + 1)
        case Unary(op, of):
            return Unary(op, _expand(of, macros, depth))
        case Binary(op, a, b):
            return Binary(op, _expand(a, macros, depth), _expand(b, macros, depth))
        case Call(n, args, kwargs):
            return Call(n, tuple(_expand(a, macros, depth) for a in args), tuple((k, _expand(v, macros, depth)) for k, v in kwargs))
    return node


def load(spec) -> dict:
    """A specification as a mapping: a mapping, a path to YAML, or YAML text."""
    if isinstance(spec, dict):
        return spec
    import yaml

    text = str(spec)
    class Loader(yaml.SafeLoader):
        """Only true and false are booleans: on, off, yes and no are names."""

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|false|False)$"), [*"tTfF"])
    made = yaml.load(Path(text).read_text(encoding="utf-8") if "\n" not in text and Path(text).exists() else text, Loader)
    if not isinstance(made, dict):
        raise SchemaError("a specification is a mapping of sections")
    return made


def _adjacent(name: str, over: str, links: list, dims: tuple[str, ...]) -> tuple[dict, dict]:
    """Binaries that choose one segment of a curve: weights of only its two ends may be positive."""
    w, z = f"{name}_weight", f"{name}_segment"
    variables = {z: {"dims": [*dims, over], "domain": "binary"}}
    constraints = {
        f"{name}_one_segment": {"dims": list(dims), "expression": f"sum({z}, over={over}) == 1"},
        f"{name}_ends": {"dims": [*dims, over], "expression": f"{w} <= {z} + shift({z}, along={over}, offset=1, edge=0)"},
        f"{name}_last": {"dims": [*dims, over], "where": f"position({over}) == -1", "expression": f"{z} == 0"},
    }
    return variables, constraints


def _piecewise(spec: dict, p: Program) -> dict:
    """Piecewise links rewritten into variables and constraints."""
    spec = {**spec, **{s: dict(spec.get(s) or {}) for s in ("variables", "constraints", "sos")}}
    for name, given in (spec.get("piecewise") or {}).items():
        over, links, method = given["over"], given["links"], given.get("method", "adjacency")
        base = [*dict.fromkeys(d for e, x, *_ in links for d in (*p.dims(_expand(parse(e), spec.get("macros") or {})), *p.dims(parse(x))) if d != over)]
        dims = p.ordered(base)
        if method == "lp":  # the second link bounds the first's curve segment by segment: convex from below, and only two links
            (e, x), (f, y, *sense) = links
            ahead = lambda t: f"shift({t}, along={over}, offset=-1)"
            step = f"(({ahead(y)} - {y}) / ({ahead(x)} - {x}))"
            spec["constraints"][f"{name}_above"] = {"dims": [*dims, over], "where": f"not position({over}) == -1", "expression": f"({f}) - ({e}) * {step} {(sense or ['>='])[0]} {y} - {x} * {step}"}
            p.curves.append((name, over, x, y, (sense or [">="])[0]))
            continue
        if method not in ("convex", "sos2", "adjacency"):
            raise SchemaError(f"piecewise {name}: no method {method}; there are convex, lp, sos2, adjacency")
        w = f"{name}_weight"
        spec["variables"][w] = {"dims": [*dims, over], "bounds": {"lower": 0, "upper": 1}}
        spec["constraints"][f"{name}_weights"] = {"dims": list(dims), "expression": f"sum({w}, over={over}) == 1"}
        if given.get("points"):  # a curve runs as far as its own points do
            spec["variables"][w]["where"] = given["points"]
        for k, (e, x, *sense) in enumerate(links):
            spec["constraints"][f"{name}_link_{k}"] = {"dims": list(dims), "expression": f"{e} {(sense or ['=='])[0]} sum({w} * {x}, over={over})"}
        if method == "sos2":
            spec["sos"][f"{name}_adjacent"] = {"variable": w, "along": over, "type": 2}
        elif method == "adjacency":
            variables, constraints = _adjacent(name, over, links, dims)
            spec["variables"] |= variables
            spec["constraints"] |= constraints
        elif len(links) == 2:
            p.curves.append((name, over, links[0][1], links[1][1], (links[1][2:] or [">="])[0]))
    return spec


def program(source) -> Program:
    """Parse, check and expand a specification; no data is read."""
    spec = load(source)
    if any((spec.get("given") or {}).values()):
        names = sorted(n for section in spec["given"].values() for n in (section or {}))
        raise LanguageError(f"the specification reads {', '.join(names)} as given, so it is a fragment; merge it with those that declare them")
    for section in spec:
        if section not in SECTIONS:
            near = get_close_matches(section, SECTIONS, 1)
            raise SchemaError(f"unknown section {section}" + (f"; did you mean {near[0]}?" if near else ""))
    p, macros = Program(), spec.get("macros") or {}
    tree = lambda f: None if f is None else _expand(parse(f), macros)
    seen: dict[str, str] = {}

    def fit(name: str) -> str:
        if not isinstance(name, str) or not name.isidentifier() or name.lower().startswith("rowloom_") or name.lower() in ("and", "or", "not", "true", "false"):
            raise SchemaError(f"{name!r} can't be a name")
        return name

    def alone(names, what: str) -> None:
        """Names of a space of their own: none twice, however it is written."""
        lower: dict[str, str] = {}
        for name in names:
            if (other := lower.setdefault(fit(name).lower(), name)) != name:
                raise SchemaError(f"{what}: {other} and {name} differ only in case")

    def own(name: str, section: str) -> str:
        fit(name)
        if section == "dimensions" and name.lower() in ("value", "ord"):
            raise SchemaError(f"a dimension can't be called {name}")
        if name.lower() in seen:
            raise SchemaError(f"{name} is declared twice: in {seen[name.lower()]} and {section}")
        seen[name.lower()] = section
        return name

    for n, d in (spec.get("dimensions") or {}).items():
        d = d or {}
        if d.get("dtype", "str") not in DTYPES[:4]:
            raise SchemaError(f"dimension {n}: no dtype {d['dtype']}")
        p.dimensions[own(n, "dimensions")] = Dimension(n, d.get("dtype", "str"), bool(d.get("ordered", False)))
    for n, r in (spec.get("relations") or {}).items():
        r = r or {}
        of = lambda c: dict(c) if isinstance(c, dict) else {x: x for x in _listed(c)}
        key, values = of(r.get("key")), of(r.get("values"))
        columns = {**key, **values} or of(r.get("columns"))
        if both := [c for c in key if c in values]:
            raise SchemaError(f"relation {n}: column {both[0]} is both key and value")
        alone(columns, f"relation {n}")
        if "value" in columns or "ord" in columns:
            raise SchemaError(f"relation {n}: a column can't be called value or ord")
        if stray := [d for d in columns.values() if d not in p.dimensions]:
            raise SchemaError(f"relation {n}: no dimension {stray[0]}")
        p.relations[own(n, "relations")] = Relation(n, columns, tuple(key) if key and values else (), r.get("missing", "neutral"))
    for n, q in (spec.get("parameters") or {}).items():
        q = q or {}
        dims = _listed(q.get("dims"))
        if stray := [d for d in dims if d not in p.dimensions]:
            raise SchemaError(f"parameter {n}: no dimension {stray[0]}")
        if q.get("dtype", "float") not in ("float", "int", "bool", "str"):
            raise SchemaError(f"parameter {n}: no dtype {q['dtype']}")
        p.parameters[own(n, "parameters")] = Parameter(n, dims, q.get("dtype", "float"), q.get("missing", "refused"))
    for n, v in (spec.get("variables") or {}).items():
        _variable(p, own(n, "variables"), v, tree)
    for n, e in (spec.get("expressions") or {}).items():
        own(n, "expressions")
        e = e if isinstance(e, dict) else {"expression": e}
        if "cases" in e:
            p.expressions[n] = Cases(tuple((tree(c["when"]), tree(c["expression"])) for c in e["cases"].values()), tree(e.get("otherwise")))
        else:
            p.expressions[n] = tree(e["expression"])
    for n, c in (spec.get("conditions") or {}).items():
        p.conditions[own(n, "conditions")] = tree(c["where"] if isinstance(c, dict) and "where" in c else c.get("condition") if isinstance(c, dict) else c)
    if spec.get("piecewise"):
        spec = _piecewise(spec, p)
        for n, v in spec["variables"].items():
            if n not in p.variables:
                _variable(p, own(n, "variables"), v, tree)
    for section in ("constraints", "assumptions", "sos", "piecewise", "macros"):
        alone(spec.get(section) or {}, section)
    for n, c in (spec.get("constraints") or {}).items():
        e = tree(c["expression"])
        if not isinstance(e, Binary) or e.op not in ("<=", ">=", "=="):
            raise LanguageError(f"constraint {n} needs one of <=, >=, ==")
        p.constraints[n] = Constraint(n, _listed(c.get("dims")), e.left, e.op, e.right, tree(c.get("where")))
    for n, s in (spec.get("sos") or {}).items():
        kind = int(s["type"])
        if kind not in (1, 2) or s["variable"] not in p.variables or s["along"] not in p.variables[s["variable"]].dims:
            raise SchemaError(f"sos {n}: type 1 or 2 along a dimension of its variable")
        p.sos[n] = Sos(n, s["variable"], s["along"], kind)
    for n, a in (spec.get("assumptions") or {}).items():
        a = a if isinstance(a, dict) else {"holds": a}
        p.assumptions[n] = (tree(a["holds"]), tree(a.get("where")))
    if spec.get("objective"):
        p.sense = spec["objective"].get("sense", "minimize")
        if p.sense not in ("minimize", "maximize"):
            raise SchemaError(f"no sense {p.sense}")
        p.objective = tree(spec["objective"]["expression"])
    _check(p)
    return p


def _variable(p: Program, n: str, v: dict, tree) -> None:
    v = v or {}
    dims, bounds, domain = _listed(v.get("dims")), v.get("bounds") or {}, v.get("domain", "continuous")
    if stray := [d for d in dims if d not in p.dimensions]:
        raise SchemaError(f"variable {n}: no dimension {stray[0]}")
    if domain not in ("continuous", "binary", "integer"):
        raise SchemaError(f"variable {n}: no domain {domain}")
    p.variables[n] = Variable(n, dims, tree(v.get("where")), tree(bounds.get("lower")), tree(bounds.get("upper")), domain, v.get("missing", "absent"))


def _check(p: Program) -> None:
    def inside(what: str, node, dims) -> None:
        if node is not None and (stray := set(p.dims(node)) - set(dims)):
            raise DimensionError(f"{what} has a dimension {', '.join(sorted(stray))} that it isn't declared over")

    for v in p.variables.values():
        for what, node in (("where", v.where), ("lower bound", v.lower), ("upper bound", v.upper)):
            inside(f"{what} of variable {v.name}", node, v.dims)
    for e in p.expressions.values():
        p.dims(e)
        p.degree(e)
    for c in p.constraints.values():
        for node in (c.left, c.right, c.where):
            inside(f"constraint {c.name}", node, c.dims)
        p.degree(Binary("-", c.left, c.right))
    if p.objective is not None:
        inside("the objective", p.objective, ())
        p.degree(p.objective)



def merge(fragments: list) -> dict:
    """One specification of several fragments.

    A name may stand in several fragments if they agree on it. An expression
    with `adds_to: name` is a term of that name: a name that fragments read
    under `given: expressions:` and none declares is the sum of its terms, zero
    without any. What nobody declares stays given, so the result may be a
    fragment too.
    """
    made: dict = {}
    given: dict[str, dict] = {}
    terms: dict[str, list[str]] = {}
    for fragment in map(load, fragments):
        for section, content in fragment.items():
            if section == "given":
                for kind, names in (content or {}).items():
                    given.setdefault(kind, {}).update(names or {})
            elif section in ("version", "description", "notation") or not isinstance(content, dict):
                made.setdefault(section, content)
            elif section == "objective":
                if made.get(section, content) != content:
                    raise SchemaError("two fragments have an objective")
                made[section] = content
            else:
                own = made.setdefault(section, {})
                for name, value in content.items():
                    if section == "expressions" and isinstance(value, dict) and "adds_to" in value:
                        value = dict(value)
                        terms.setdefault(value.pop("adds_to"), []).append(name)
                    if own.get(name, value) != value:
                        raise SchemaError(f"{section}: fragments differ on {name}")
                    own[name] = value
    expressions = made.setdefault("expressions", {})
    for name in dict.fromkeys([*given.get("expressions", {}), *terms]):
        if name in expressions and name in terms:
            raise SchemaError(f"{name} is declared and added to")
        if name not in expressions:
            expressions[name] = {"expression": " + ".join(terms.get(name, ["0"]))}
    left = {kind: {n: v for n, v in names.items() if n not in (made.get(kind) or {})} for kind, names in given.items()}
    return made | ({"given": left} if any(left.values()) else {})


def without_sets(source) -> dict:
    """The specification with special-ordered sets, those of curves included, written out in binaries.

    Of a set of type 1 one member may differ from zero, of type 2 two
    neighbours; members need finite bounds, which the rows are made of.
    """
    spec = load(source)
    p = program(spec)
    if spec.get("piecewise"):
        spec = {**_piecewise(spec, p)}
        spec.pop("piecewise")
    spec = {**spec, "variables": dict(spec.get("variables") or {}), "constraints": dict(spec.get("constraints") or {})}
    for name, s in p.sos.items():
        bounds = spec["variables"][s.variable].get("bounds") or {}
        v = p.variables[s.variable]
        if v.upper is None and v.domain != "binary":
            raise LanguageError(f"sos {name}: {s.variable} has no upper bound to make rows of")
        upper, lower, chosen = bounds.get("upper", 1), bounds.get("lower", 0), f"{name}_chosen"
        rest = [d for d in v.dims if d != s.along]
        may = chosen if s.kind == 1 else f"({chosen} + shift({chosen}, along={s.along}, offset=1, edge=0))"
        where = (spec["variables"][s.variable] or {}).get("where")
        cut = {"where": where} if where is not None else {}
        spec["variables"][chosen] = {"dims": [*v.dims], "domain": "binary"}
        spec["constraints"][f"{name}_at_most"] = {"dims": [*v.dims], **cut, "expression": f"{s.variable} <= ({upper}) * {may}"}
        if lower != 0:
            spec["constraints"][f"{name}_at_least"] = {"dims": [*v.dims], **cut, "expression": f"{s.variable} >= ({lower}) * {may}"}
        spec["constraints"][f"{name}_one"] = {"dims": rest, "expression": f"sum({chosen}, over={s.along}) <= 1"}
        if s.kind == 2:
            spec["constraints"][f"{name}_last"] = {"dims": [*v.dims], "where": f"position({s.along}) == -1", "expression": f"{chosen} == 0"}
    spec.pop("sos", None)
    return spec
