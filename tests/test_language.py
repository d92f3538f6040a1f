"""Formulas and specifications, without data."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rowloom.errors import DimensionError, LanguageError, SchemaError
from rowloom.functions.formula import Binary, Call, Name, Num, Unary, parse
from rowloom.plans.spec import program

BASE = {
    "dimensions": {"t": {"dtype": "int", "ordered": True}, "g": {"dtype": "str"}},
    "parameters": {"cost": {"dims": ["g"]}, "load": {"dims": ["t"]}},
    "variables": {"p": {"dims": ["t", "g"], "bounds": {"lower": 0}}},
}


def spec(**more):
    return {**BASE, **more}


def test_precedence():
    assert parse("1 + 2 * 3") == Binary("+", Num(1), Binary("*", Num(2), Num(3)))
    assert parse("2 ** 3 ** 2") == Binary("**", Num(2), Binary("**", Num(3), Num(2)))
    assert parse("-a ** 2") == Unary("-", Binary("**", Name("a"), Num(2)))
    assert parse("not a == 1 or b and c") == Binary("or", Unary("not", Binary("==", Name("a"), Num(1))), Binary("and", Name("b"), Name("c")))
    assert parse("NOT a AND b") == parse("not a and b")
    assert parse("a - b - c") == Binary("-", Binary("-", Name("a"), Name("b")), Name("c"))


def test_call():
    node = parse("sum(p, over=[t, g])")
    assert isinstance(node, Call) and node.get("over").items == (Name("t"), Name("g"))


@pytest.mark.parametrize("bad", ["1 +", "(a", "a b", "f(x=1, 2)", "a $ b", ""])
def test_refused_text(bad):
    with pytest.raises(LanguageError):
        parse(bad)


@given(st.recursive(st.integers(0, 9).map(str), lambda s: st.tuples(s, st.sampled_from("+-*"), s).map(lambda x: f"({x[0]} {x[1]} {x[2]})")))
def test_arithmetic_reads_as_python(text):
    def value(n):
        return n.value if isinstance(n, Num) else -value(n.of) if isinstance(n, Unary) else {"+": int.__add__, "-": int.__sub__, "*": int.__mul__}[n.op](value(n.left), value(n.right))

    assert value(parse(text)) == eval(text)


@pytest.mark.parametrize(
    ("more", "error"),
    [
        ({"parametres": {}}, SchemaError),
        ({"expressions": {"e": "sum(p, over=nope)"}}, DimensionError),
        ({"expressions": {"e": "p * p * p"}}, LanguageError),
        ({"expressions": {"e": "cost / p"}}, LanguageError),
        ({"expressions": {"e": "median(p)"}}, LanguageError),
        ({"expressions": {"COST": "load"}}, SchemaError),
        ({"expressions": {"e": "shift(p, along=g, offset=1)"}}, SchemaError),
        ({"constraints": {"c": {"dims": ["t"], "expression": "p == load"}}}, DimensionError),
        ({"constraints": {"c": {"dims": ["t"], "expression": "sum(p, over=g)"}}}, LanguageError),
        ({"dimensions": {"value": {}}}, SchemaError),
    ],
)
def test_refused_specifications(more, error):
    with pytest.raises(error):
        program(spec(**more))


def test_hint():
    with pytest.raises(SchemaError, match="did you mean parameters"):
        program(spec(parametres={}))


def test_macro_and_dimensions():
    p = program(spec(macros={"w": {"args": ["a", "b"], "kwargs": ["over"], "template": "sum(a * b, over=over)"}}, expressions={"e": "w(p, cost, over=g)"}))
    assert p.dims(p.expressions["e"]) == ("t",) and p.degree(p.expressions["e"]) == 1
    with pytest.raises(LanguageError):
        program(spec(macros={"w": {"args": ["a"], "template": "w(a)"}}, expressions={"e": "w(p)"}))


@pytest.mark.parametrize(
    ("part", "said"),
    [
        ({"dimensions": {"Value": {}}}, "can't be called"),
        ({"dimensions": {"d": {}}, "relations": {"r": {"key": "d", "values": {"D": "d"}}}}, "differ only in case"),
        ({"dimensions": {"d": {}}, "relations": {"r": {"key": {"value": "d"}}}}, "value or ord"),
        ({"dimensions": {"d": {}}, "relations": {"r": {"key": {"a b": "d"}}}}, "can't be a name"),
        ({"variables": {"x": {}}, "constraints": {"c": {"expression": "x <= 1"}, "C": {"expression": "x >= 0"}}}, "differ only in case"),
        ({"parameters": {"Rowloom_p": {}}}, "can't be a name"),
    ],
)
def test_refused_names(part, said):
    with pytest.raises(SchemaError, match=said):
        program(part)
