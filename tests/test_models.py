"""Small models with known optima, absence rules, refusals, text output, sweeps and archives."""

import pytest

import rowloom
from rowloom import archive, sweeps
from rowloom.errors import DataError, LanguageError, NoSolutionError, SinkError

DISPATCH = {
    "dimensions": {"t": {"dtype": "int", "ordered": True}, "g": {"dtype": "str"}},
    "parameters": {"p_max": {"dims": ["g"]}, "cost": {"dims": ["g"]}, "load": {"dims": ["t"]}},
    "variables": {"p": {"dims": ["t", "g"], "where": "p_max > 0", "bounds": {"lower": 0, "upper": "p_max"}}},
    "expressions": {"supply": "sum(p, over=g)"},
    "constraints": {"balance": {"dims": ["t"], "expression": "supply == load"}},
    "objective": {"sense": "minimize", "expression": "sum(p * cost)"},
}
DATA = {"t": [0, 1], "g": ["wind", "gas", "oil"], "p_max": {"wind": 60.0, "gas": 100.0, "oil": 0.0}, "cost": {"wind": 0.0, "gas": 50.0, "oil": 80.0}, "load": [50.0, 90.0]}


def values(df):
    return {tuple(r[:-1]) if len(r) > 2 else r[0]: r[-1] for r in df.collect()}


@pytest.fixture(scope="module")
def solved(spark):
    model = rowloom.build(spark, DISPATCH, DATA)
    return model, model.solve()


def test_dispatch(solved):
    model, result = solved
    assert (model.handoff.n_cols, model.handoff.n_rows) == (4, 2)  # the retired unit has no columns
    assert result.objective == pytest.approx(1500) and result.status == "ok"
    assert values(result.primal("p")) == pytest.approx({(0, "wind"): 50, (0, "gas"): 0, (1, "wind"): 60, (1, "gas"): 30})
    assert values(result.dual("balance"))[1] == pytest.approx(50)
    assert values(result.reduced_cost("p"))[(1, "wind")] == pytest.approx(-50)
    assert values(result.slack("balance")) == pytest.approx({0: 0, 1: 0})
    assert values(result.activity("balance")) == pytest.approx({0: 50, 1: 90})
    assert values(result.evaluate("supply / load")) == pytest.approx({0: 1, 1: 1})
    assert values(result.evaluate("dual(balance) * load"))[1] == pytest.approx(4500)
    assert [r["variable"] for r in model.row("balance", t=0).collect()] == ["p", "p"]
    assert model.diagnostics()["omitted"]["p"] == 2


def test_update(spark):
    model = rowloom.build(spark, DISPATCH, DATA)
    assert model.update({"load": [10.0, 20.0]}).solve().objective == pytest.approx(0)
    assert model.update({"load": [1000.0, 20.0]}).solve().termination_condition == "infeasible"
    with pytest.raises(NoSolutionError):
        model.solve().primal("p")


def test_infeasible_subsystem(spark):
    model = rowloom.build(spark, DISPATCH, DATA | {"load": [1000.0, 20.0]})
    assert [(r["constraint"], r["coordinate"]) for r in model.infeasible_subsystem().collect()] == [("balance", "t=0")]
    assert rowloom.build(spark, DISPATCH, DATA).infeasible_subsystem().count() == 0


def test_text(spark, solved, tmp_path):
    model, _ = solved
    lp = (tmp_path / "m.lp").name and open(model.write(tmp_path / "m.lp")).read()
    assert lp.startswith("Minimize\n obj:\n+ 50 x1\n+ 50 x3\nSubject To\n c0:\n+ 1 x0\n+ 1 x1\n = 50\n c1:") and lp.endswith(" 0 <= x3 <= 100\nEnd\n")
    mps = open(model.write(tmp_path / "m.mps")).read()
    assert "\n E c0\n E c1\nCOLUMNS\n x0 c0 1\n x1 obj 50\n x1 c0 1\n" in mps and mps.endswith("ENDATA\n")
    with pytest.raises(SinkError):
        model.write(tmp_path / "m.txt")


def test_storage_wraps_in_order(spark):
    """A store that must end where it began; rows in any order build the same model."""
    spec = {
        "dimensions": {"t": {"dtype": "int", "ordered": True}},
        "parameters": {"price": {"dims": ["t"]}},
        "variables": {"buy": {"dims": ["t"], "bounds": {"lower": 0, "upper": 4}}, "soc": {"dims": ["t"], "bounds": {"lower": 0, "upper": 6}}},
        "constraints": {"store": {"dims": ["t"], "expression": "soc == shift(soc, along=t, offset=1, edge='wrap') + buy - 2"}},
        "objective": {"expression": "sum(buy * price)"},
    }
    tables = [[(0, 5.0), (1, 1.0), (2, 9.0)], [(2, 9.0), (0, 5.0), (1, 1.0)]]
    found = []
    for rows in tables:
        model = rowloom.build(spark, spec, {"t": [0, 1, 2], "price": spark.createDataFrame(rows, "t int, value double")})
        found.append((sorted(map(tuple, model.handoff.matrix.collect())), model.solve().objective))
    assert found[0] == found[1] and found[0][1] == pytest.approx(4 * 1 + 2 * 5)


def test_knapsack(spark):
    spec = {"dimensions": {"i": {"dtype": "str"}}, "parameters": {"w": {"dims": ["i"]}, "v": {"dims": ["i"]}}, "variables": {"x": {"dims": ["i"], "domain": "binary"}}, "constraints": {"room": {"expression": "sum(x * w) <= 10"}}, "objective": {"sense": "maximize", "expression": "sum(x * v)"}}
    result = rowloom.solve(spark, spec, {"i": [*"abcd"], "w": dict(zip("abcd", (5.0, 4.0, 6.0, 3.0))), "v": dict(zip("abcd", (10.0, 40.0, 30.0, 50.0)))})
    assert result.objective == 90
    with pytest.raises(NoSolutionError):
        result.dual("room")


@pytest.mark.parametrize("method", ["convex", "lp", "adjacency"])
def test_piecewise(spark, method):
    spec = {
        "dimensions": {"b": {"dtype": "int", "ordered": True}},
        "parameters": {"x": {"dims": ["b"]}, "y": {"dims": ["b"]}},
        "variables": {"p": {"bounds": {"lower": 0, "upper": 10}}, "c": {"bounds": {"lower": 0}}},
        "piecewise": {"curve": {"over": "b", "links": [["p", "x"], ["c", "y"]], "method": method}},
        "constraints": {"need": {"expression": "p == 6"}},
        "objective": {"expression": "c"},
    }
    assert rowloom.solve(spark, spec, {"b": [0, 1, 2], "x": [0.0, 4.0, 10.0], "y": [0.0, 4.0, 22.0]}).objective == pytest.approx(10)
    if method != "adjacency":
        with pytest.raises(DataError, match="not convex"):
            rowloom.build(spark, spec, {"b": [0, 1, 2], "x": [0.0, 4.0, 10.0], "y": [0.0, 4.0, 5.0]})


RULES = {"dimensions": {"t": {"dtype": "int", "ordered": True}, "g": {"dtype": "str"}}, "relations": {"of": {"key": "t", "values": "g"}}, "parameters": {"a": {"dims": ["t"], "missing": "neutral"}, "b": {"dims": ["t"], "missing": "absent"}, "z": {"dims": ["t"], "missing": 0}, "n": {"dims": ["g"], "dtype": "int"}}}


def rules(spark, formula, **tables):
    row = lambda *r: spark.createDataFrame(list(r), "t int, value double")
    given = {"t": [0, 1, 2, 3], "g": ["x", "y"], "of": spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "t int, g string"), "a": row((0, 1.0), (2, 3.0)), "b": row((1, 10.0), (2, 20.0)), "z": row((3, 4.0), (2, 0.0)), "n": {"x": 1, "y": 2}}
    return values(rowloom.evaluate(spark, RULES, given | tables, formula))


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("a", {0: 1, 1: 0, 2: 3, 3: 0}),
        ("a + b", {1: 10, 2: 23}),
        ("b", {1: 10, 2: 20}),
        ("z", {0: 0, 1: 0, 2: 0, 3: 4}),
        ("sum(b, over=t, by=of[g])", {"x": 10, "y": 20}),
        ("sum(z, over=t, by=of[g]) + n", {"x": 1, "y": 2}),
        ("at(n, by=of[g])", {0: 1, 1: 1, 2: 2}),
        ("b / z", {}),
        ("shift(b, along=t, offset=1)", {2: 10, 3: 20}),
        ("shift(b, along=t, offset=1, edge=5)", {0: 5, 2: 10, 3: 20}),
        ("shift(z, along=t, offset=1, edge='wrap')", {0: 4, 1: 0, 2: 0, 3: 0}),
        ("shift(b, along=t, offset=1, within=of[g])", {}),
        ("shift(b, along=t, offset=-1, within=of[g])", {0: 10}),
        ("sum_back(z, along=t, window=2)", {0: 0, 1: 0, 2: 0, 3: 4}),
        ("sum_back(z, along=t, window=2, edge='wrap')", {0: 4, 1: 0, 2: 0, 3: 4}),
        ("z ** 2 - 1", {0: -1, 1: -1, 2: -1, 3: 15}),
    ],
)
def test_absence(spark, formula, want):
    assert rules(spark, formula) == pytest.approx(want)


@pytest.mark.parametrize(
    ("name", "rows", "message"),
    [("z", [(0, None)], "null or NaN"), ("z", [(0, 1.0), (0, 2.0)], "two rows"), ("z", [(9, 1.0)], "no label"), ("z", [(0, float("nan"))], "null or NaN")],
)
def test_refused_tables(spark, name, rows, message):
    with pytest.raises(DataError, match=message):
        rules(spark, "z", **{name: spark.createDataFrame(rows, "t int, value double")})


def test_refused_names(spark):
    with pytest.raises(DataError, match="unknown source"):
        rules(spark, "z", zz=1)
    with pytest.raises(DataError, match="no row for t=1"):
        rowloom.evaluate(spark, {"dimensions": {"t": {"dtype": "int"}}, "parameters": {"a": {"dims": ["t"]}}}, {"t": [0, 1], "a": spark.createDataFrame([(0, 1.0)], "t int, value double")}, "a")
    with pytest.raises(DataError, match="twice"):
        rules(spark, "z", g=["x", "x"])


def test_missing_divisor_is_refused_in_a_build(spark):
    spec = {**DISPATCH, "parameters": {**DISPATCH["parameters"], "eff": {"dims": ["g"], "missing": "neutral"}}, "constraints": {"balance": {"dims": ["t"], "expression": "sum(p / eff, over=g) == load"}}}
    eff = spark.createDataFrame([("wind", 1.0)], "g string, value double")
    with pytest.raises(DataError, match="eff"):
        rowloom.build(spark, spec, DATA | {"eff": eff})
    zero = spark.createDataFrame([("wind", 1.0), ("gas", 0.0), ("oil", 1.0)], "g string, value double")
    with pytest.raises(DataError, match="not finite"):
        rowloom.build(spark, spec, DATA | {"eff": zero})


def test_assumption(spark):
    with pytest.raises(DataError, match="assumption cheap fails at"):
        rowloom.build(spark, {**DISPATCH, "assumptions": {"cheap": "cost < 60"}}, DATA)


def test_windows_cover_and_carry(spark):
    spec = {
        "dimensions": {"t": {"dtype": "int", "ordered": True}},
        "parameters": {"load": {"dims": ["t"]}, "start": {}},
        "variables": {"buy": {"dims": ["t"], "bounds": {"lower": 0, "upper": 9}}, "soc": {"dims": ["t"], "bounds": {"lower": 0, "upper": 5}}},
        "constraints": {"first": {"dims": ["t"], "where": "position(t) == 0", "expression": "soc == start + buy - load"}, "next": {"dims": ["t"], "where": "not position(t) == 0", "expression": "soc == shift(soc, along=t, offset=1) + buy - load"}},
        "objective": {"expression": "sum(buy)"},
    }
    data = {"t": [0, 1, 2, 3], "load": [1.0, 2.0, 3.0, 4.0], "start": 3.0}
    sweep = rowloom.solve_over(spark, spec, data, rowloom.EachWindow("t", 2, 1, {"start": "soc"}))
    bought = sweep.primal("buy")
    assert bought.count() == 4 and sum(r["value"] for r in bought.collect()) == pytest.approx(7)
    assert [r["objective"] for r in sweep.records] == pytest.approx([3, 7])
    with pytest.raises(LanguageError):
        rowloom.solve_over(spark, spec, data, rowloom.EachWindow("t", 2))


def test_each_label(spark):
    load = spark.createDataFrame([(y, t, float(10 * y + t)) for y in (1, 2) for t in (0, 1)], "year int, t int, value double")
    sweep = rowloom.solve_over(spark, DISPATCH, DATA | {"load": load}, sweeps.EachLabel("year"))
    assert sweep.key == "year" and sorted(r["year"] for r in sweep.records) == [1, 2]
    assert sweep.evaluate("supply").count() == 4


def test_archive(spark, solved, tmp_path):
    model, result = solved
    root = f"file://{tmp_path}"
    runs = {archive.save(model, result, root), archive.save(model, result, root)}
    assert {r["run_id"] for r in archive.catalog(spark, root).collect()} == runs
    assert archive.scan(spark, root, "primal", "p").count() == 8
    spec, tables = archive.inputs(spark, root, sorted(runs)[0])
    assert rowloom.solve(spark, spec, tables).objective == pytest.approx(1500)
