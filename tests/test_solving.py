"""Models with known optima, quadratic objectives, sets in binaries, fragments, saved answers, starts, bases, rays and slices."""

import math

import pytest
from pyspark.sql import functions as F

import rowloom
from rowloom.errors import DataError, LanguageError, LayoutError, NoSolutionError, SinkError
from rowloom.plans.assembly import row_starts
from tests.test_models import DATA, DISPATCH, values


def frame(spark, schema, *rows):
    return spark.createDataFrame([*rows], schema)


SHIPPING = {
    "dimensions": {"plant": {"dtype": "str"}, "market": {"dtype": "str"}},
    "parameters": {"capacity": {"dims": ["plant"]}, "demand": {"dims": ["market"]}, "distance": {"dims": ["plant", "market"]}, "freight": {}},
    "variables": {"x": {"dims": ["plant", "market"], "bounds": {"lower": 0}}},
    "constraints": {"supply": {"dims": ["plant"], "expression": "sum(x, over=market) <= capacity"}, "met": {"dims": ["market"], "expression": "sum(x, over=plant) >= demand"}},
    "objective": {"expression": "sum(x * freight * distance / 1000)"},
}


def shipping(spark):
    miles = {("seattle", "new-york"): 2.5, ("seattle", "chicago"): 1.7, ("seattle", "topeka"): 1.8, ("san-diego", "new-york"): 2.5, ("san-diego", "chicago"): 1.8, ("san-diego", "topeka"): 1.4}
    return {"plant": ["seattle", "san-diego"], "market": ["new-york", "chicago", "topeka"], "capacity": {"seattle": 350, "san-diego": 600}, "demand": {"new-york": 325, "chicago": 300, "topeka": 275}, "distance": frame(spark, "plant string, market string, value double", *((*k, v) for k, v in miles.items())), "freight": 90.0}


def test_shipping(spark):
    result = rowloom.solve(spark, SHIPPING, shipping(spark))
    assert result.objective == pytest.approx(153.675)
    assert values(result.dual("met")) == pytest.approx({"new-york": 0.225, "chicago": 0.153, "topeka": 0.126})


def test_time_grouped_through_a_relation(spark):
    """A cheap unit with a budget per month: the dear one takes the rest."""
    spec = {
        "dimensions": {"t": {"dtype": "int", "ordered": True}, "g": {"dtype": "str"}, "month": {"dtype": "str"}},
        "relations": {"month_of": {"key": "t", "values": "month"}},
        "parameters": {"budget": {"dims": ["g", "month"], "missing": "absent"}, "load": {"dims": ["t"]}, "cost": {"dims": ["g"]}},
        "variables": {"p": {"dims": ["t", "g"], "bounds": {"lower": 0}}},
        "constraints": {"balance": {"dims": ["t"], "expression": "sum(p, over=g) == load"}, "within": {"dims": ["g", "month"], "expression": "sum(p, over=t, by=month_of[month]) <= budget"}},
        "objective": {"expression": "sum(p * cost)"},
    }
    data = {"t": [0, 1, 2, 3], "g": ["hydro", "gas"], "month": ["jan", "feb"], "month_of": frame(spark, "t int, month string", (0, "jan"), (1, "jan"), (2, "feb"), (3, "feb")), "budget": frame(spark, "g string, month string, value double", ("hydro", "jan", 5.0), ("hydro", "feb", 30.0)), "load": [10.0, 10.0, 10.0, 10.0], "cost": {"hydro": 1.0, "gas": 10.0}}
    model = rowloom.build(spark, spec, data)
    assert model.handoff.n_rows == 4 + 2  # gas has no budget, so no row
    assert model.solve().objective == pytest.approx(5 + 150 + 20)


def test_minimum_up_time(spark):
    """A trailing window by a parameter: a unit that starts stays on as long as it must."""
    spec = {
        "dimensions": {"t": {"dtype": "int", "ordered": True}, "g": {"dtype": "str"}},
        "parameters": {"up": {"dims": ["g"], "dtype": "int"}, "load": {"dims": ["t"]}, "size": {"dims": ["g"]}, "fixed": {"dims": ["g"]}},
        "variables": {"on": {"dims": ["t", "g"], "domain": "binary"}, "begin": {"dims": ["t", "g"], "domain": "binary"}},
        "constraints": {"need": {"dims": ["t"], "expression": "sum(on * size, over=g) >= load"}, "started": {"dims": ["t", "g"], "expression": "begin >= on - shift(on, along=t, offset=1, edge=0)"}, "stays": {"dims": ["t", "g"], "expression": "sum_back(begin, along=t, window=up) <= on"}},
        "objective": {"expression": "sum(on * fixed) + sum(begin)"},
    }
    data = {"t": [0, 1, 2, 3], "g": ["a", "b"], "up": {"a": 3, "b": 1}, "load": [5.0, 0.0, 0.0, 0.0], "size": {"a": 10.0, "b": 6.0}, "fixed": {"a": 1.0, "b": 2.5}}
    result = rowloom.solve(spark, spec, data)
    assert result.objective == pytest.approx(3.5) and values(result.primal("on"))[0, "b"] == 1
    assert rowloom.solve(spark, spec, data | {"load": [9.0, 0.0, 0.0, 0.0]}).objective == pytest.approx(4)


HOLDINGS = {"dimensions": {"i": {"dtype": "str"}}, "parameters": {"risk": {"dims": ["i"]}, "gain": {"dims": ["i"]}}, "variables": {"w": {"dims": ["i"], "bounds": {"lower": 0, "upper": 1}}}, "constraints": {"all": {"expression": "sum(w) == 1"}}, "objective": {"expression": "sum(w * w * risk) - sum(w * gain)"}}


def test_convex_quadratic_objective(spark):
    data = {"i": ["a", "b", "c"], "risk": {"a": 1.0, "b": 2.0, "c": 4.0}, "gain": {"a": 0.0, "b": 0.0, "c": -9.0}}
    result = rowloom.solve(spark, HOLDINGS, data)
    assert values(result.primal("w")) == pytest.approx({"a": 2 / 3, "b": 1 / 3, "c": 0}, abs=1e-6)
    assert result.objective == pytest.approx(2 / 3) and values(result.reduced_cost("w"))["a"] == pytest.approx(0, abs=1e-5)
    best = rowloom.solve(spark, {**HOLDINGS, "objective": {"sense": "maximize", "expression": "sum(w * gain) - sum(w * w * risk)"}}, data)
    assert best.objective == pytest.approx(-2 / 3)
    with pytest.raises(SinkError, match="nonconvex"):
        rowloom.solve(spark, HOLDINGS, data | {"risk": {"a": 1.0, "b": -2.0, "c": 4.0}})
    whole = {**HOLDINGS, "variables": {"w": {"dims": ["i"], "domain": "binary"}}}
    model = rowloom.build(spark, whole, data)
    assert model.check_sink("solver") == {"integrality", "quadratic_objective"} and not model.check_sink("lp")
    with pytest.raises(SinkError, match="with"):
        model.solve()


@pytest.mark.parametrize(("kind", "best"), [(1, 6.0), (2, 9.0)])
def test_sets_in_binaries(spark, kind, best):
    """The dearest member alone, or the best two neighbours."""
    spec = {"dimensions": {"k": {"dtype": "int", "ordered": True}}, "parameters": {"v": {"dims": ["k"]}}, "variables": {"x": {"dims": ["k"], "bounds": {"lower": 0, "upper": 1}}}, "sos": {"few": {"variable": "x", "along": "k", "type": kind}}, "objective": {"sense": "maximize", "expression": "sum(x * v)"}}
    data = {"k": [0, 1, 2, 3], "v": [6.0, 1.0, 5.0, 4.0]}
    assert "sos" in rowloom.build(spark, spec, data).check_sink("solver")
    assert rowloom.solve(spark, rowloom.without_sets(spec), data).objective == pytest.approx(best)
    with pytest.raises(LanguageError, match="no upper bound"):
        rowloom.without_sets({**spec, "variables": {"x": {"dims": ["k"]}}})


def test_curve_by_sets_in_binaries(spark):
    spec = {"dimensions": {"b": {"dtype": "int", "ordered": True}}, "parameters": {"x": {"dims": ["b"]}, "y": {"dims": ["b"]}}, "variables": {"p": {"bounds": {"lower": 0, "upper": 10}}, "c": {"bounds": {"lower": 0}}}, "piecewise": {"curve": {"over": "b", "links": [["p", "x"], ["c", "y"]], "method": "sos2"}}, "constraints": {"need": {"expression": "p == 7"}}, "objective": {"expression": "c"}}
    data = {"b": [0, 1, 2], "x": [0.0, 4.0, 10.0], "y": [0.0, 8.0, 11.0]}  # concave, so neighbours matter
    assert rowloom.solve(spark, rowloom.without_sets(spec), data).objective == pytest.approx(9.5)


GRID = {"dimensions": {"t": {"dtype": "int", "ordered": True}, "bus": {"dtype": "str"}}, "given": {"expressions": {"injection": {"dims": ["t", "bus"]}, "total": {"dims": []}}}, "constraints": {"balance": {"dims": ["t", "bus"], "expression": "injection == 0"}}, "objective": {"expression": "total"}}
UNITS = {"dimensions": {"t": {"dtype": "int", "ordered": True}, "bus": {"dtype": "str"}, "g": {"dtype": "str"}}, "relations": {"g_bus": {"key": "g", "values": "bus"}}, "parameters": {"size": {"dims": ["g"]}, "cost": {"dims": ["g"]}}, "variables": {"p": {"dims": ["t", "g"], "bounds": {"lower": 0, "upper": "size"}}}, "given": {"expressions": {"injection": {}, "total": {}}}, "expressions": {"from_units": {"expression": "sum(p, over=g, by=g_bus[bus])", "adds_to": "injection"}, "spent": {"expression": "sum(p * cost)", "adds_to": "total"}}}
LOADS = {"dimensions": {"t": {"dtype": "int", "ordered": True}, "bus": {"dtype": "str"}}, "parameters": {"load": {"dims": ["t", "bus"]}}, "given": {"expressions": {"injection": {}}}, "expressions": {"to_loads": {"expression": "-load", "adds_to": "injection"}}}


def test_fragments(spark):
    data = {"t": [0, 1], "bus": ["n"], "g": ["a", "b"], "g_bus": frame(spark, "g string, bus string", ("a", "n"), ("b", "n")), "size": {"a": 5.0, "b": 9.0}, "cost": {"a": 1.0, "b": 3.0}, "load": frame(spark, "t int, bus string, value double", (0, "n", 4.0), (1, "n", 7.0))}
    assert rowloom.solve(spark, rowloom.merge([GRID, UNITS, LOADS]), data).objective == pytest.approx(4 + 5 + 6)
    with pytest.raises(LanguageError, match="injection, total"):
        rowloom.check(GRID)
    with pytest.raises(LanguageError, match="differ on t"):
        rowloom.merge([GRID, {"dimensions": {"t": {"dtype": "str"}}}])
    with pytest.raises(LanguageError, match="as given"):
        rowloom.check(rowloom.merge([{"dimensions": {"t": {}}, "given": {"parameters": {"q": {}}}}]))


def test_saved_answers(spark, tmp_path):
    model = rowloom.build(spark, DISPATCH, DATA)
    path = f"file://{tmp_path}/answer"
    result = model.solve(save_to=path, outputs=("slack", "reduced_cost", "variable_basis"))
    saved = rowloom.load_result(spark, path)
    assert (saved.status, saved.objective) == ("ok", pytest.approx(1500)) and saved.record["has_primal"]
    for kind, name in (("primal", "p"), ("dual", "balance"), ("expression", "supply"), ("slack", "balance"), ("reduced_cost", "p"), ("variable_basis", "p")):
        own = getattr(result, "evaluate" if kind == "expression" else kind)(name)
        assert values(rowloom.scan_result(spark, path, kind, name)) == values(own)
    with pytest.raises(NoSolutionError):
        saved.activity("balance")
    with pytest.raises(LayoutError):
        rowloom.load_result(spark, f"file://{tmp_path}/nothing")
    assert set(values(result.variable_basis("p")).values()) <= {"basic", "at_lower", "at_upper"}
    assert set(values(result.constraint_basis("balance")).values()) <= {"basic", "fixed", "at_lower"}
    assert values(result.metrics())["columns"] == 4
    assert result.to_pandas("balance", "dual").loc[1, "value"] == pytest.approx(50)


def test_ray_of_an_infeasible_model(spark):
    """Weights of the rows that no values of the columns can meet."""
    result = rowloom.solve(spark, DISPATCH, DATA | {"load": [1000.0, 20.0]})
    ray = values(result.dual_ray("balance"))
    assert result.status == "warning" and ray[0] * 1000 + ray[1] * 20 > sum(max(0, ray[t]) * (60 + 100) for t in (0, 1)) + 1e-6
    with pytest.raises(NoSolutionError):
        rowloom.solve(spark, DISPATCH, DATA).dual_ray("balance")


def test_start_of_a_whole_model(spark):
    spec = {"dimensions": {"i": {"dtype": "int"}}, "parameters": {"w": {"dims": ["i"]}}, "variables": {"x": {"dims": ["i"], "domain": "binary"}}, "constraints": {"room": {"expression": "sum(x * w) <= 11"}}, "objective": {"sense": "maximize", "expression": "sum(x * w)"}}
    data = {"i": [*range(6)], "w": [2.0, 3.0, 4.0, 5.0, 6.0, 7.0]}
    model = rowloom.build(spark, spec, data)
    first = model.solve()
    again = model.solve(start=first)
    assert first.objective == again.objective == 11 and again.answer.facts["nodes"] <= first.answer.facts["nodes"]
    given = frame(spark, "i int, value double", *((i, float(i in (3, 4))) for i in range(6)))
    assert model.solve(start={"x": given}).objective == 11
    assert model.solve(start={"x": given.withColumn("value", F.lit(1.0))}).objective == 11  # what doesn't fit is left
    with pytest.raises(LanguageError, match="no variable"):
        model.solve(start={"y": given})


def test_structure_and_diagnostics(spark):
    model = rowloom.build(spark, DISPATCH, DATA)
    before = model.structure()
    assert model.update({"load": [20.0, 30.0], "cost": {"wind": 1.0, "gas": 2.0, "oil": 3.0}}).structure() == before
    assert model.update({"p_max": {"wind": 60.0, "gas": 100.0, "oil": 1.0}}).structure() != before
    told = model.diagnostics()
    assert told["sparse_parameters"].count() == 0 and set(told["seconds"]) == {"attach", "build"}
    starts = values(row_starts(model.handoff))
    assert starts == {0: 0, 1: 3}
    sparse = rowloom.build(spark, {**DISPATCH, "parameters": {**DISPATCH["parameters"], "cost": {"dims": ["g"], "missing": "neutral"}}}, DATA | {"cost": {"gas": 50.0}})
    assert [tuple(r) for r in sparse.diagnostics()["sparse_parameters"].collect()] == [("cost", 3, 1, 2)]


def test_declarations_over_no_label(spark):
    spec = {**DISPATCH, "dimensions": {**DISPATCH["dimensions"], "s": {"dtype": "str"}}, "variables": {**DISPATCH["variables"], "store": {"dims": ["t", "s"]}}, "constraints": {**DISPATCH["constraints"], "limit": {"dims": ["t", "s"], "expression": "store <= 3"}}}
    model = rowloom.build(spark, spec, DATA | {"s": []})
    assert (model.handoff.n_cols, model.handoff.n_rows) == (4, 2) and model.solve().objective == pytest.approx(1500)


def test_slices_at_a_time_spilled_and_resumed(spark, tmp_path):
    load = frame(spark, "year int, t int, value double", *((y, t, float(10 * y + t)) for y in (1, 2, 3) for t in (0, 1)))
    axis, path = rowloom.EachLabel("year"), f"file://{tmp_path}/sweep"
    data = DATA | {"load": load}
    serial = rowloom.solve_over(spark, DISPATCH, data, axis)
    spilled = rowloom.solve_over(spark, DISPATCH, data, axis, workers=3, spill_to=path, outputs=("slack",))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(serial.primal("p")) == rows(spilled.primal("p")) and spilled.slack("balance").count() == 6
    assert [r["objective"] for r in serial.records] == [r["objective"] for r in spilled.records]
    again = rowloom.solve_over(spark, DISPATCH, DATA | {"load": load.withColumn("value", F.col("value") * 100)}, axis, spill_to=path)
    assert rows(again.primal("p")) == rows(spilled.primal("p"))  # nothing was solved anew
    assert sorted(rowloom.load_sweep(spark, path).results) == ["1", "2", "3"]
    one = rowloom.build_slice(spark, DISPATCH, data, axis, 2)
    assert one.solve().objective == pytest.approx(serial.results[2].objective)
    with pytest.raises(DataError, match="no slice"):
        rowloom.build_slice(spark, DISPATCH, data, axis, 9)
    with pytest.raises(LanguageError, match="chains"):
        rowloom.solve_over(spark, DISPATCH, data, rowloom.EachLabel("year", {"cost": "cost"}), workers=2)


def test_labelled_arrays_are_refused_and_arrow_tables_read(spark):
    import pyarrow as pa

    class Labelled:
        coords, dims = {}, ("t",)

    with pytest.raises(DataError, match="labelled array"):
        rowloom.build(spark, DISPATCH, DATA | {"load": Labelled()})
    table = pa.table({"t": [0, 1], "value": [50.0, 90.0]})
    assert rowloom.solve(spark, DISPATCH, DATA | {"load": table}).objective == pytest.approx(1500)
    assert math.isclose(rowloom.solve(spark, DISPATCH, DATA | {"load": table.to_pandas()}).objective, 1500)
