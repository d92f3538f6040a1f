"""Queries over the sample tables, one per operator of the modelling engine, with the SQL that checks them.

The models are built from the tables as they are: nations, customers, suppliers
and parts are dimensions, months of orders are an ordered one, and relations
come from the foreign keys. Sums of doubles are rounded on both sides, because
the order of addition differs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import api, sweeps
from rowloom.archive import union_runs
from rowloom.plans.assembly import Handoff, build, diagnostics
from rowloom.plans.compiler import Compiler
from rowloom.plans.spec import program
from rowloom.functions.formula import parse
from rowloom.errors import ModelError
from rowloom.sinks import text
from rowloom.sources import door

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SPEC = {
    "dimensions": {
        "nation": {"dtype": "int"},
        "region": {"dtype": "int"},
        "customer": {"dtype": "int"},
        "supplier": {"dtype": "int"},
        "part": {"dtype": "int"},
        "brand": {"dtype": "str"},
        "segment": {"dtype": "str"},
        "month": {"dtype": "int", "ordered": True},
        "year": {"dtype": "int"},
    },
    "relations": {
        "cust_nation": {"key": "customer", "values": "nation"},
        "nation_region": {"key": "nation", "values": "region"},
        "part_brand": {"key": "part", "values": "brand"},
        "month_year": {"key": "month", "values": "year"},
        "supplies": {"columns": ["supplier", "part"]},
        "cust_place": {"key": "customer", "values": ["segment", "nation"]},
        "cust_other": {"key": "customer", "values": {"other": "nation"}},
        "month_first": {"key": "month", "values": {"first": "month"}},
    },
    "parameters": {
        "acctbal": {"dims": ["customer"]},
        "supbal": {"dims": ["supplier"]},
        "price": {"dims": ["part"]},
        "size": {"dims": ["part"], "dtype": "int"},
        "kind": {"dims": ["part"], "dtype": "str"},
        "sales": {"dims": ["month"]},
        "orders": {"dims": ["month"]},
        "lag": {"dims": ["year"], "dtype": "int"},
        "seg_bal": {"dims": ["segment", "nation"], "missing": "neutral"},
        "seg_abs": {"dims": ["segment", "nation"], "missing": "absent"},
        "seg_zero": {"dims": ["segment", "nation"], "missing": 0},
        "rich": {"dims": ["supplier"], "dtype": "bool"},
        "region_rate": {"dims": ["region"]},
    },
    "variables": {
        "ship": {"dims": ["supplier", "nation"], "where": "supbal > 0", "bounds": {"lower": 0, "upper": "supbal"}},
        "use": {"dims": ["supplier"], "domain": "binary"},
        "flow": {"dims": ["month"], "bounds": {"lower": 0}},
    },
    "expressions": {
        "priced": {"cases": {"large": {"when": "size > 25", "expression": "price * 0.9"}, "small": {"when": "size <= 5", "expression": "price + 1"}}, "otherwise": "5"},
    },
    "macros": {"share": {"args": ["x"], "kwargs": ["over"], "template": "x / sum(x, over=over)"}},
    "conditions": {"big": "size > 40 and price > 950"},
    "constraints": {
        "demand": {"dims": ["nation"], "expression": "sum(ship, over=supplier) >= sum(acctbal, over=customer, by=cust_nation[nation]) / 1000"},
        "capacity": {"dims": ["supplier"], "where": "supbal > 0", "expression": "sum(ship, over=nation) <= supbal * use"},
        "balance": {"dims": ["month"], "expression": "flow - shift(flow, along=month, offset=1) == sales"},
    },
    "objective": {"sense": "minimize", "expression": "sum(ship * (2 + supbal / 1000)) + sum(use * 100)"},
    "sos": {"one_flow": {"variable": "flow", "along": "month", "type": 1}},
}

MONTHS = """m AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month, SUM(o_totalprice) AS v, CAST(COUNT(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
d AS (SELECT month, v, n, CAST(row_number() OVER (ORDER BY month) - 1 AS BIGINT) AS ord, COUNT(*) OVER () AS size, CAST(month // 12 AS BIGINT) AS year FROM m)"""
SEGMENTS = "s AS (SELECT c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, SUM(c_acctbal) AS v FROM customer GROUP BY 1, 2 HAVING SUM(c_acctbal) > 0)"


class Tables(dict):
    """Sample tables, read when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def sources(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    """Those of the model's tables, made from the sample tables; only months are numbered."""
    t = Tables(spark, sf_dir)
    label = lambda df, c, name: df.select(F.col(c).cast("bigint").alias(name), F.col(c).cast("bigint").alias("ord"))
    monthly = cache(lambda: t["orders"].groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("bigint").alias("month")).agg(F.sum("o_totalprice").alias("sales"), F.count("*").cast("double").alias("orders")).persist())
    segments = cache(lambda: t["customer"].groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.sum("c_acctbal").alias("value")).filter("value > 0").persist())
    years = lambda: monthly().select("month", F.floor(F.col("month") / 12).cast("bigint").alias("year"))
    made = {
        "nation": lambda: label(t["nation"], "n_nationkey", "nation"),
        "region": lambda: label(t["region"], "r_regionkey", "region"),
        "customer": lambda: label(t["customer"], "c_custkey", "customer"),
        "supplier": lambda: label(t["supplier"], "s_suppkey", "supplier"),
        "part": lambda: label(t["part"], "p_partkey", "part"),
        "brand": lambda: t["part"].select(F.col("p_brand").alias("brand")).distinct(),
        "segment": lambda: t["customer"].select(F.col("c_mktsegment").alias("segment")).distinct(),
        "month": lambda: monthly().select("month"),
        "year": lambda: years().select("year").distinct(),
        "cust_nation": lambda: t["customer"].select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation")),
        "nation_region": lambda: t["nation"].select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")),
        "part_brand": lambda: t["part"].select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")),
        "month_year": lambda: years(),
        "supplies": lambda: t["lineitem"].select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).distinct().persist(),
        "cust_place": lambda: t["customer"].select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")),
        "cust_other": lambda: t["customer"].select(F.col("c_custkey").alias("customer"), F.pmod("c_custkey", F.lit(25)).alias("other")),
        "month_first": lambda: years().join(years().groupBy("year").agg(F.min("month").alias("first")), "year").select("month", "first"),
        "acctbal": lambda: t["customer"].select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("value")),
        "supbal": lambda: t["supplier"].select(F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("value")),
        "price": lambda: t["part"].select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("value")),
        "size": lambda: t["part"].select(F.col("p_partkey").alias("part"), F.col("p_size").alias("value")),
        "kind": lambda: t["part"].select(F.col("p_partkey").alias("part"), F.col("p_type").alias("value")),
        "sales": lambda: monthly().select("month", F.col("sales").alias("value")),
        "orders": lambda: monthly().select("month", F.col("orders").alias("value")),
        "lag": lambda: years().select("year", F.pmod(F.col("year"), F.lit(3)).cast("int").alias("value")).distinct(),
        "seg_bal": segments,
        "seg_abs": segments,
        "seg_zero": segments,
        "rich": lambda: t["supplier"].select(F.col("s_suppkey").alias("supplier"), (F.col("s_acctbal") > 0).alias("value")),
        "region_rate": lambda: t["region"].select(F.col("r_regionkey").alias("region"), (F.col("r_regionkey") + 1).cast("double").alias("value")),
    }
    return {n: made[n]() for n in names}


def _part(names: set[str]) -> dict:
    """The specification cut to some declarations and what they stand on."""
    p = program(SPEC)
    dims = {d for n in names - {*SPEC["expressions"], *SPEC["conditions"]} for d in (p.parameters[n].dims if n in p.parameters else p.variables[n].dims if n in p.variables else p.relations[n].columns.values() if n in p.relations else (n,))}
    keep = names | dims
    sections = {s: {k: v for k, v in SPEC[s].items() if k in keep} for s in ("dimensions", "relations", "parameters", "variables", "expressions", "conditions")}
    return sections | {"macros": SPEC["macros"]}


def _model(spark: SparkSession, sf_dir: str, names: str, constraints: tuple[str, ...] = (), objective: bool = False, sos: bool = False) -> tuple[dict, dict]:
    spec = _part(set(names.split()))
    if constraints:
        spec["constraints"] = {c: SPEC["constraints"][c] for c in constraints}
    if objective:
        spec["objective"] = SPEC["objective"]
    if sos:
        spec["sos"] = SPEC["sos"]
    return spec, sources(spark, sf_dir, [k for s in ("dimensions", "relations", "parameters") for k in spec[s]])


def _expression(name: str, uses: str, formula: str, sql: str, digits: int = 4) -> None:
    """Register the value of a formula; columns are its dimensions and `value`."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec, given = _model(spark, sf_dir, uses)
        return api.evaluate(spark, spec, given, formula, ordered=False).withColumn("value", F.round("value", digits))

    QUERIES[name], ORACLE_SQL[name] = query, sql


def _mask(name: str, uses: str, mask: str, sql: str) -> None:
    """Register the coordinates that a mask admits."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec, given = _model(spark, sf_dir, uses)
        return Compiler(door.attach(spark, program(spec), given), values={}).admitted(parse(mask))

    QUERIES[name], ORACLE_SQL[name] = query, sql


def _built(spark: SparkSession, sf_dir: str, names: str, constraints=(), objective=False, sos=False) -> Handoff:
    spec, given = _model(spark, sf_dir, names, constraints, objective, sos)
    return build(door.attach(spark, program(spec), given))


def _table(name: str, names: str, constraints: tuple[str, ...], read: Callable[[Handoff], DataFrame], sql: str, objective: bool = False, sos: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: read(_built(spark, sf_dir, names, constraints, objective, sos))
    ORACLE_SQL[name] = sql


# expressions

_expression("q_constant", "nation", "2 * 3.5 + 1", "SELECT 8.0 AS value")
_expression("q_parameter", "customer acctbal", "acctbal", "SELECT c_custkey AS customer, round(c_acctbal, 4) AS value FROM customer")
_expression("q_negate_add", "part price size", "-price + size - 1", "SELECT p_partkey AS part, round(-p_retailprice + p_size - 1, 4) AS value FROM part")
_expression("q_param_product", "region_rate seg_zero nation_region region segment nation", "region_rate * seg_zero", f"WITH {SEGMENTS} SELECT segment, nation, region, round(coalesce(v, 0.0) * rate, 4) AS value FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer) CROSS JOIN (SELECT CAST(n_nationkey AS BIGINT) AS nation FROM nation) CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(r_regionkey + 1 AS DOUBLE) AS rate FROM region) LEFT JOIN s USING (segment, nation)", 2)
_expression("q_sum_over", "seg_bal", "sum(seg_bal, over=segment)", f"WITH {SEGMENTS} SELECT CAST(n_nationkey AS BIGINT) AS nation, round(coalesce(sum(v), 0.0), 2) AS value FROM nation LEFT JOIN s ON nation = n_nationkey GROUP BY 1", 2)
_expression("q_sum_all", "acctbal", "sum(acctbal)", "SELECT round(sum(c_acctbal), 2) AS value FROM customer", 2)
_expression("q_sum_by_keyed", "acctbal cust_nation", "sum(acctbal, over=customer, by=cust_nation[nation])", "SELECT CAST(n_nationkey AS BIGINT) AS nation, round(coalesce(sum(c_acctbal), 0.0), 2) AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", 2)
_expression("q_sum_by_bare", "supbal supplies part_brand", "sum(sum(supbal, over=supplier, by=supplies[part]), over=part, by=part_brand[brand])", "WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT p_brand AS brand, round(coalesce(sum(s_acctbal), 0.0), 2) AS value FROM part LEFT JOIN r ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1", 2)
_expression("q_at_pullback", "region_rate nation_region", "at(region_rate, by=nation_region[region])", "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey + 1 AS DOUBLE) AS value FROM nation")
_expression("q_shift_edge", "sales", "shift(sales, along=month, offset=1)", f"WITH {MONTHS} SELECT t.month, round(s.v, 2) AS value FROM d t JOIN d s ON s.ord = t.ord - 1", 2)
_expression("q_shift_ahead", "sales", "shift(sales, along=month, offset=-2)", f"WITH {MONTHS} SELECT t.month, round(s.v, 2) AS value FROM d t JOIN d s ON s.ord = t.ord + 2", 2)
_expression("q_shift_wrap", "sales", "shift(sales, along=month, offset=1, edge='wrap')", f"WITH {MONTHS} SELECT t.month, round(s.v, 2) AS value FROM d t JOIN d s ON s.ord = (t.ord - 1 + t.size) % t.size", 2)
_expression("q_shift_fill", "sales", "shift(sales, along=month, offset=1, edge=7)", f"WITH {MONTHS} SELECT t.month, round(coalesce(s.v, 7.0), 2) AS value FROM d t LEFT JOIN d s ON s.ord = t.ord - 1", 2)
_expression("q_shift_within", "sales month_year", "shift(sales, along=month, offset=1, edge='wrap', within=month_year[year])", f"WITH {MONTHS}, g AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY month) - 1 AS o, count(*) OVER (PARTITION BY year) AS n_of FROM d) SELECT t.month, round(s.v, 2) AS value FROM g t JOIN g s ON s.year = t.year AND s.o = (t.o - 1 + t.n_of) % t.n_of", 2)
_expression("q_shift_by_parameter", "sales month_year lag", "shift(sales, along=month, offset=lag, within=month_year[year])", f"WITH {MONTHS}, g AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY month) - 1 AS o FROM d) SELECT t.month, round(s.v, 2) AS value FROM g t JOIN g s ON s.year = t.year AND s.o = t.o - (t.year % 3)", 2)
_expression("q_sum_back", "sales", "sum_back(sales, along=month, window=3)", f"WITH {MONTHS} SELECT t.month, round(sum(s.v), 2) AS value FROM d t JOIN d s ON s.ord BETWEEN t.ord - 2 AND t.ord GROUP BY 1", 2)
_expression("q_sum_back_wrap", "sales", "sum_back(sales, along=month, window=4, edge='wrap')", f"WITH {MONTHS} SELECT t.month, round(sum(s.v), 2) AS value FROM d t JOIN d s ON (t.ord - s.ord + t.size) % t.size < 4 GROUP BY 1", 2)
_expression("q_divide", "sales orders", "sales / orders", f"WITH {MONTHS} SELECT month, round(v / n, 4) AS value FROM d")
_expression("q_divide_zero_absent", "seg_zero", "1000 / seg_zero", f"WITH {SEGMENTS} SELECT segment, nation, round(1000 / v, 6) AS value FROM s WHERE v <> 0", 6)
_expression("q_power", "size", "(size / 10) ** 2", "SELECT p_partkey AS part, round((p_size / 10.0) * (p_size / 10.0), 4) AS value FROM part")
_expression("q_macro_share", "sales", "share(sales, over=month)", f"WITH {MONTHS} SELECT month, round(v / (SELECT sum(v) FROM d), 8) AS value FROM d", 8)
_expression("q_cases", "price size priced", "priced", "SELECT p_partkey AS part, round(CASE WHEN p_size > 25 THEN p_retailprice * 0.9 WHEN p_size <= 5 THEN p_retailprice + 1 ELSE 5.0 END, 4) AS value FROM part")
_expression("q_presence", "seg_abs", "seg_abs + 1", f"WITH {SEGMENTS} SELECT segment, nation, round(v + 1, 2) AS value FROM s", 2)

# masks

_mask("q_mask_compare", "acctbal", "acctbal > 5000", "SELECT c_custkey AS customer FROM customer WHERE c_acctbal > 5000")
_mask("q_mask_text", "kind", "kind == 'MEDIUM'", "SELECT p_partkey AS part FROM part WHERE p_type = 'MEDIUM'")
_mask("q_mask_defined", "seg_bal", "seg_bal", f"WITH {SEGMENTS} SELECT segment, nation FROM s")
_mask("q_mask_flag", "rich", "not rich", "SELECT s_suppkey AS supplier FROM supplier WHERE NOT s_acctbal > 0")
_mask("q_mask_expression", "price size", "price <= 20 * size", "SELECT p_partkey AS part FROM part WHERE p_retailprice <= 20.0 * p_size")
_mask("q_mask_count", "seg_bal", "count(seg_bal > 60000, over=segment) >= 2", f"WITH {SEGMENTS} SELECT nation FROM s WHERE v > 60000 GROUP BY 1 HAVING count(*) >= 2")
_mask("q_mask_shift", "sales orders", "shift(orders > 170, along=month, offset=1)", f"WITH {MONTHS} SELECT t.month FROM d t JOIN d s ON s.ord = t.ord - 1 WHERE s.n > 170")
_mask("q_mask_at", "region_rate nation_region", "at(region_rate >= 3, by=nation_region[region])", "SELECT CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE n_regionkey + 1 >= 3")
_mask("q_mask_dimension", "part", "part > 100 and not part == 150", "SELECT p_partkey AS part FROM part WHERE p_partkey > 100 AND p_partkey <> 150")
_mask("q_mask_position", "sales", "position(month) == 0 or position(month) == -1", f"WITH {MONTHS} SELECT month FROM d WHERE ord = 0 OR ord = size - 1")
_mask("q_mask_position_within", "sales month_year", "position(month, within=month_year[year]) == 0", f"WITH {MONTHS} SELECT min(month) AS month FROM d GROUP BY year")
_mask("q_mask_relation", "nation_region", "nation_region == 2", "SELECT CAST(n_nationkey AS BIGINT) AS nation FROM nation WHERE n_regionkey = 2")
_mask("q_mask_relation_defined", "supplies", "supplies", "SELECT DISTINCT l_suppkey AS supplier, l_partkey AS part FROM lineitem")
_mask("q_mask_condition", "size price big", "big or size == 1", "SELECT p_partkey AS part FROM part WHERE (p_size > 40 AND p_retailprice > 950) OR p_size = 1")

# the tables of a model: suppliers ship to nations, and a chain of months

SHIP = "ship use supbal acctbal cust_nation"
SHIPPED = "x AS (SELECT s_suppkey, n_nationkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_suppkey, n_nationkey) - 1 AS BIGINT) AS col FROM supplier CROSS JOIN nation WHERE s_acctbal > 0), u AS (SELECT s_suppkey, s_acctbal, CAST((SELECT count(*) FROM x) + row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS col FROM supplier), k AS (SELECT s_suppkey, CAST((SELECT count(*) FROM nation) + row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS \"row\" FROM supplier WHERE s_acctbal > 0)"
BOTH = ("demand", "capacity")

_table("q_labels_masked", SHIP, (), lambda h: h.variables["ship"].select("supplier", "nation", F.col("var").alias("col")), f"WITH {SHIPPED} SELECT s_suppkey AS supplier, CAST(n_nationkey AS BIGINT) AS nation, col FROM x")
_table("q_labels_dense", "use supbal", (), lambda h: h.variables["use"].select("supplier", F.col("var").alias("col")), "SELECT s_suppkey AS supplier, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS col FROM supplier")
_table("q_cols", SHIP, (), lambda h: h.cols.withColumn("ub", F.round("ub", 4)), f"WITH {SHIPPED} SELECT col, 0.0 AS lb, round(s_acctbal, 4) AS ub, 'continuous' AS vtype FROM x UNION ALL SELECT col, 0.0, 1.0, 'binary' FROM u")
_table("q_rows", SHIP, BOTH, lambda h: h.rows.withColumn("rhs", F.round("rhs", 4)), f"WITH {SHIPPED} SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS \"row\", '>=' AS sense, round(coalesce(b, 0.0), 4) AS rhs FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) / 1000 AS b FROM customer GROUP BY 1) ON c_nationkey = n_nationkey UNION ALL SELECT \"row\", '<=', 0.0 FROM k")
_table("q_matrix", SHIP, BOTH, lambda h: h.matrix.withColumn("coeff", F.round("coeff", 4)), f"WITH {SHIPPED}, r AS (SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS \"row\" FROM nation) SELECT r.\"row\", x.col, 1.0::DOUBLE AS coeff FROM x JOIN r USING (n_nationkey) UNION ALL SELECT k.\"row\", x.col, 1.0 FROM x JOIN k USING (s_suppkey) UNION ALL SELECT k.\"row\", u.col, round(-u.s_acctbal, 4) FROM u JOIN k USING (s_suppkey)")
_table("q_obj", SHIP, BOTH, lambda h: h.obj.withColumn("coeff", F.round("coeff", 8)), f"WITH {SHIPPED} SELECT col, round(2 + s_acctbal / 1000, 8) AS coeff FROM x UNION ALL SELECT col, 100.0 FROM u", objective=True)
_table("q_shift_matrix", "flow sales", ("balance",), lambda h: h.matrix, f"WITH {MONTHS} SELECT CAST(t.ord - 1 AS BIGINT) AS \"row\", CAST(t.ord AS BIGINT) AS col, 1.0::DOUBLE AS coeff FROM d t WHERE t.ord > 0 UNION ALL SELECT t.ord - 1, t.ord - 1, -1.0 FROM d t WHERE t.ord > 0")
_table("q_sos", "flow sales", ("balance",), lambda h: h.sos, f"WITH {MONTHS} SELECT CAST(0 AS BIGINT) AS \"set\", CAST(1 AS INTEGER) AS type, ord AS col, ord + 1 AS weight FROM d", sos=True)


def _quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, given = _model(spark, sf_dir, "flow sales")
    spec["objective"] = {"sense": "minimize", "expression": "sum(flow * flow * 2) - sum(flow * shift(flow, along=month, offset=1))"}
    return build(door.attach(spark, program(spec), given)).quad


QUERIES["q_quad_pairs"] = _quadratic
ORACLE_SQL["q_quad_pairs"] = f"WITH {MONTHS} SELECT ord AS col_l, ord AS col_r, 2.0::DOUBLE AS coeff FROM d UNION ALL SELECT ord - 1, ord, -1.0 FROM d WHERE ord > 0"


def _slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slack of every row at a made-up solution: column c has the value c mod 7."""
    h = _built(spark, sf_dir, SHIP, BOTH)
    activity = h.matrix.groupBy("row").agg(F.sum(F.col("coeff") * F.pmod("col", F.lit(7))).alias("v"))
    return api.slack_of(h.rows, activity).select("row", F.round("v", 2).alias("slack"))


def _reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced costs at made-up duals: row r has the dual r mod 5."""
    h = _built(spark, sf_dir, SHIP, BOTH, objective=True)
    y = h.rows.select("row", F.pmod("row", F.lit(5)).cast("double").alias("v"))
    return api.reduced_costs(h.cols, h.obj, h.matrix, y).select("col", F.round("v", 2).alias("reduced_cost"))


MODEL_SQL = {"rows": ORACLE_SQL["q_rows"], "matrix": ORACLE_SQL["q_matrix"], "cols": ORACLE_SQL["q_cols"], "obj": ORACLE_SQL["q_obj"]}
QUERIES["q_slack"] = _slack
ORACLE_SQL["q_slack"] = f"""SELECT r."row", round(CASE WHEN sense = '>=' THEN a.v - rhs ELSE rhs - a.v END, 2) AS slack FROM ({MODEL_SQL['rows']}) r JOIN (SELECT "row", sum(coeff * (col % 7)) AS v FROM ({MODEL_SQL['matrix']}) GROUP BY 1) a USING ("row")"""
QUERIES["q_reduced_cost"] = _reduced
ORACLE_SQL["q_reduced_cost"] = f"""SELECT c.col, round(coalesce(o.coeff, 0.0) - coalesce(p.v, 0.0), 2) AS reduced_cost FROM ({MODEL_SQL['cols']}) c LEFT JOIN ({MODEL_SQL['obj']}) o USING (col) LEFT JOIN (SELECT col, sum(coeff * ("row" % 5)) AS v FROM ({MODEL_SQL['matrix']}) GROUP BY 1) p USING (col)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnostics(_built(spark, sf_dir, SHIP, BOTH, objective=True))
    return spark.createDataFrame([(k, round(v[0], 2), round(v[1], 2)) for k, v in found.items() if v], "part string, least double, greatest double")


QUERIES["q_diagnostics_ranges"] = _ranges
ORACLE_SQL["q_diagnostics_ranges"] = " UNION ALL ".join(
    f"SELECT '{part}' AS part, round(min(abs({c})), 2) AS least, round(max(abs({c})), 2) AS greatest FROM ({MODEL_SQL[t]}) WHERE {c} <> 0" for part, t, c in (("matrix", "matrix", "coeff"), ("objective", "obj", "coeff"), ("rhs", "rows", "rhs"), ("bounds", "cols", "ub"))
)


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, given = _model(spark, sf_dir, "sales")
    return door.attach(spark, program(spec), given).dimensions["month"]


QUERIES["q_window_slices"] = lambda spark, sf_dir: sweeps.windows(_months(spark, sf_dir), "month", 12, 3)
ORACLE_SQL["q_window_slices"] = f"WITH {MONTHS} SELECT CAST(w.w AS BIGINT) AS \"window\", month, ord, ord // 12 = w.w AS owned FROM d JOIN (SELECT DISTINCT ord // 12 AS w FROM d) w ON ord >= w.w * 12 AND ord < w.w * 12 + 15"


def _stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's answer for a month is the month's place in the window; the owner's counts."""
    seen = sweeps.windows(_months(spark, sf_dir), "month", 12, 3)
    answers = seen.select("window", "month", (F.col("ord") - 12 * F.col("window")).alias("value"))
    return sweeps.stitched(answers, seen, "month")


QUERIES["q_stitch"] = _stitch
ORACLE_SQL["q_stitch"] = f"WITH {MONTHS} SELECT CAST(ord // 12 AS BIGINT) AS \"window\", month, ord % 12 AS value FROM d"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return union_runs({"a": nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "b": region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))})


QUERIES["q_warehouse_union"] = _runs
ORACLE_SQL["q_warehouse_union"] = "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region, 'a' AS run_id FROM nation UNION ALL SELECT r_regionkey, r_name, NULL, 'b' FROM region"


# totals of several terms, absence, relations over one dimension twice and onto a pair

_expression("q_factor_totalled", "price size", "(price + size - 1) * (size + 2)", "SELECT p_partkey AS part, round((p_retailprice + p_size - 1) * (p_size + 2), 4) AS value FROM part")
EVERY_SEGMENT = "p AS (SELECT segment, CAST(n_nationkey AS BIGINT) AS nation FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer) CROSS JOIN nation)"
_expression("q_divisor_added_up", "seg_bal", "1000 / (seg_bal + 1)", f"WITH {SEGMENTS}, {EVERY_SEGMENT} SELECT segment, nation, round(1000 / (coalesce(v, 0.0) + 1), 6) AS value FROM p LEFT JOIN s USING (segment, nation)", 6)
_expression("q_power_added_up", "seg_bal", "(seg_bal / 1000 - 1) ** 2", f"WITH {SEGMENTS}, {EVERY_SEGMENT} SELECT segment, nation, round((coalesce(v, 0.0) / 1000 - 1) * (coalesce(v, 0.0) / 1000 - 1), 4) AS value FROM p LEFT JOIN s USING (segment, nation)")
_expression("q_absence_before_sum", "seg_abs", "sum(seg_abs + 1, over=segment)", f"WITH {SEGMENTS} SELECT CAST(n_nationkey AS BIGINT) AS nation, round(coalesce(sum(v + 1), 0.0), 2) AS value FROM nation LEFT JOIN s ON nation = n_nationkey GROUP BY 1", 2)
_expression("q_at_self_map", "sales month_first", "sales - at(sales, by=month_first[first])", f"WITH {MONTHS} SELECT t.month, round(t.v - f.v, 2) AS value FROM d t JOIN (SELECT year, min(month) AS first FROM d GROUP BY 1) y USING (year) JOIN d f ON f.month = y.first", 2)
_expression("q_sum_self_map", "sales month_first", "sum(sales, over=month, by=month_first[first])", f"WITH {MONTHS}, g AS (SELECT min(month) AS month, sum(v) AS v FROM d GROUP BY year) SELECT d.month, round(coalesce(g.v, 0.0), 2) AS value FROM d LEFT JOIN g USING (month)", 2)
_expression("q_sum_onto_pair", "acctbal cust_place", "sum(acctbal, over=customer, by=cust_place[segment, nation])", f"WITH {EVERY_SEGMENT} SELECT segment, nation, round(coalesce(sum(c_acctbal), 0.0), 2) AS value FROM p LEFT JOIN customer ON c_mktsegment = segment AND c_nationkey = nation GROUP BY 1, 2", 2)
_expression("q_sum_back_by_parameter", "sales month_year lag", "sum_back(sales, along=month, window=lag, within=month_year[year])", f"WITH {MONTHS} SELECT t.month, round(coalesce(sum(s.v), 0.0), 2) AS value FROM d t LEFT JOIN d s ON s.year = t.year AND t.month - s.month BETWEEN 0 AND t.year % 3 - 1 GROUP BY 1", 2)
_mask("q_mask_relation_pair", "cust_nation cust_other", "cust_nation == cust_other", "SELECT c_custkey AS customer FROM customer WHERE c_nationkey = c_custkey % 25")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product of two dimensions cut by one semi-join per conjunct."""
    spec, given = _model(spark, sf_dir, "supbal nation nation_region")
    mask = "supbal > 1000 and nation_region == 2 and not nation == 7"
    return Compiler(door.attach(spark, program(spec), given), values={}).masked(("nation", "supplier"), parse(mask))


QUERIES["q_mask_spine"] = _masked
ORACLE_SQL["q_mask_spine"] = "SELECT CAST(n_nationkey AS BIGINT) AS nation, s_suppkey AS supplier FROM supplier CROSS JOIN nation WHERE s_acctbal > 1000 AND n_regionkey = 2 AND n_nationkey <> 7"


def _variable_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _built(spark, sf_dir, SHIP)
    return Compiler(h.attached, h.variables).admitted(parse("ship and supbal > 3000"))


QUERIES["q_mask_variable"] = _variable_there
ORACLE_SQL["q_mask_variable"] = "SELECT s_suppkey AS supplier, CAST(n_nationkey AS BIGINT) AS nation FROM supplier CROSS JOIN nation WHERE s_acctbal > 0 AND s_acctbal > 3000"


# reads at a made-up solution: column c has the value c mod 7, row r the dual r mod 5


def _at_solution(expression: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = _built(spark, sf_dir, SHIP, BOTH)
        values = {n: f.withColumn("v", F.pmod("var", F.lit(7)).cast("double")) for n, f in h.variables.items()}
        duals = {n: f.withColumn("v", F.pmod("row", F.lit(5)).cast("double")) for n, f in h.constraints.items()}
        frame, dims = Compiler(h.attached, values=values, duals=duals).value(parse(expression))
        return frame.select(*dims, F.round("v", 4).alias("value"))

    return query


QUERIES["q_primal_read"] = _at_solution("sum(ship, over=supplier) / 10 + 1")
ORACLE_SQL["q_primal_read"] = f"WITH {SHIPPED} SELECT CAST(n_nationkey AS BIGINT) AS nation, round(sum(col % 7) / 10.0 + 1, 4) AS value FROM x GROUP BY 1"
QUERIES["q_dual_read"] = _at_solution("dual(capacity) * supbal - use")
ORACLE_SQL["q_dual_read"] = f"WITH {SHIPPED} SELECT s_suppkey AS supplier, round((k.\"row\" % 5) * u.s_acctbal - u.col % 7, 4) AS value FROM k JOIN u USING (s_suppkey)"


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, given = _model(spark, sf_dir, SHIP, BOTH)
    return api.Model(spark, spec, given).row("capacity").select("row", "variable", "coordinate", F.round("coeff", 4).alias("coeff"), "sense", "rhs")


QUERIES["q_row_spelled_out"] = _spelled
ORACLE_SQL["q_row_spelled_out"] = f"""WITH {SHIPPED} SELECT k."row", 'ship' AS variable, 'supplier=' || x.s_suppkey || ', nation=' || x.n_nationkey AS coordinate, 1.0::DOUBLE AS coeff, '<=' AS sense, 0.0::DOUBLE AS rhs FROM x JOIN k USING (s_suppkey) UNION ALL SELECT k."row", 'use', 'supplier=' || u.s_suppkey, round(-u.s_acctbal, 4), '<=', 0.0 FROM u JOIN k USING (s_suppkey)"""


# whole models of other shapes


def _months_model(name: str, more: dict, read: Callable[[Handoff], DataFrame], sql: str, uses: str = "flow sales orders") -> None:
    """Register a table of a model over months with sections of its own."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec, given = _model(spark, sf_dir, uses)
        return read(build(door.attach(spark, program({**spec, **{k: {**spec.get(k, {}), **v} for k, v in more.items()}}), given)))

    QUERIES[name], ORACLE_SQL[name] = query, sql


_months_model(
    "q_quad_rows",
    {"constraints": {"curved": {"dims": ["month"], "expression": "flow * flow - flow * shift(flow, along=month, offset=1) <= sales"}}},
    lambda h: h.qmatrix,
    f"WITH {MONTHS} SELECT ord - 1 AS \"row\", ord AS col_l, ord AS col_r, 1.0::DOUBLE AS coeff FROM d WHERE ord > 0 UNION ALL SELECT ord - 1, ord - 1, ord, -1.0 FROM d WHERE ord > 0",
)
_months_model(
    "q_objective_constant",
    {"objective": {"sense": "maximize", "expression": "sum(flow) - sum(sales) / 1000 + 5"}},
    lambda h: h.attached.spark.createDataFrame([(h.sense, round(h.constant, 2))], "sense string, constant double"),
    f"WITH {MONTHS} SELECT 'maximize' AS sense, round(5 - sum(v) / 1000, 2) AS constant FROM d",
)
_months_model(
    "q_piecewise_sos2",
    {"variables": {"p": {}, "c": {}}, "piecewise": {"curve": {"over": "month", "links": [["p", "sales"], ["c", "orders"]], "method": "sos2"}}},
    lambda h: h.sos.join(h.matrix.filter("row > 0").select("col", "row", F.round("coeff", 2).alias("coeff")), "col").select("set", "type", "col", "weight", "row", "coeff"),
    f"WITH {MONTHS}, l AS (SELECT max(ord) + 3 AS p FROM d) SELECT CAST(0 AS BIGINT) AS \"set\", 2 AS type, p + ord AS col, ord + 1 AS weight, CAST(r AS BIGINT) AS \"row\", round(CASE WHEN r = 1 THEN -v ELSE -n END, 2) AS coeff FROM d, l, (VALUES (1), (2)) t(r)",
)
_months_model(
    "q_piecewise_adjacency",
    {"variables": {"p": {}}, "piecewise": {"curve": {"over": "month", "links": [["p", "sales"], ["p", "orders"]]}}},
    lambda h: h.rows.groupBy("sense").agg(F.count("*").alias("n"), F.sum("rhs").alias("rhs")),
    f"WITH {MONTHS} SELECT '==' AS sense, CAST(5 AS BIGINT) AS n, 2.0::DOUBLE AS rhs UNION ALL SELECT '<=', count(*), 0.0 FROM d",
)
FLOWS = {"constraints": {"balance": {"dims": ["month"], "expression": "flow - shift(flow, along=month, offset=1) == orders"}}, "objective": {"expression": "sum(flow)"}}
_months_model(
    "q_lp_text",
    FLOWS,
    lambda h: text.lp_lines(h).select("section", "value"),
    f"""WITH {MONTHS} SELECT 0 AS section, unnest(['Minimize', ' obj:']) AS value UNION ALL SELECT 1, '+ 1 x' || ord FROM d UNION ALL SELECT 4, 'Subject To'
        UNION ALL SELECT 5, unnest([' c' || (ord - 1) || ':', '- 1 x' || (ord - 1), '+ 1 x' || ord, ' = ' || CAST(n AS BIGINT)]) FROM d WHERE ord > 0
        UNION ALL SELECT 6, 'Bounds' UNION ALL SELECT 8, ' 0 <= x' || ord || ' <= +inf' FROM d UNION ALL SELECT 99, 'End'""",
)
_months_model(
    "q_mps_text",
    FLOWS,
    lambda h: text.mps_lines(h).select("section", "value"),
    f"""WITH {MONTHS} SELECT 0 AS section, 'NAME model' AS value UNION ALL SELECT 1, unnest(['ROWS', ' N obj']) UNION ALL SELECT 2, ' E c' || (ord - 1) FROM d WHERE ord > 0 UNION ALL SELECT 4, 'COLUMNS'
        UNION ALL SELECT 5, ' x' || ord || ' obj 1' FROM d UNION ALL SELECT 5, unnest([' x' || ord || ' c' || (ord - 1) || ' 1', ' x' || (ord - 1) || ' c' || (ord - 1) || ' -1']) FROM d WHERE ord > 0
        UNION ALL SELECT 6, 'RHS' UNION ALL SELECT 7, ' rhs c' || (ord - 1) || ' ' || CAST(n AS BIGINT) FROM d WHERE ord > 0 UNION ALL SELECT 8, 'BOUNDS' UNION ALL SELECT 99, 'ENDATA'""",
)


def _whole_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of an integer variable that come from data: those within a millionth of a whole number become it."""
    spec, given = _model(spark, sf_dir, "size price")
    spec["variables"] = {"lots": {"dims": ["part"], "domain": "integer", "bounds": {"lower": "size / 10", "upper": "size / 10 * 10 + 0.0000001"}}}
    return build(door.attach(spark, program(spec), given)).cols


QUERIES["q_integer_bounds"] = _whole_bounds
ORACLE_SQL["q_integer_bounds"] = "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS col, p_size / 10.0 AS lb, CAST(p_size AS DOUBLE) AS ub, 'integer' AS vtype FROM part"


# ways to hand tables in

BY_REGION = """
dimensions:
  n_nationkey: {dtype: int}
  r_regionkey: {dtype: int}
relations:
  of: {key: n_nationkey, values: {n_regionkey: r_regionkey}}
expressions:
  keys: sum(n_nationkey, over=n_nationkey, by=of[n_regionkey])
"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification in YAML, and tables as parquet paths."""
    nation = f"{sf_dir}/nation.parquet"
    return api.evaluate(spark, BY_REGION, {"n_nationkey": nation, "r_regionkey": f"{sf_dir}/region.parquet", "of": nation}, "keys", ordered=False)


QUERIES["q_yaml_and_paths"] = _paths
ORACLE_SQL["q_yaml_and_paths"] = "SELECT CAST(n_regionkey AS BIGINT) AS r_regionkey, CAST(sum(n_nationkey) AS DOUBLE) AS value FROM nation GROUP BY 1"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters as a number, a mapping, a sequence, a pandas series and an Arrow table."""
    import pyarrow as pa

    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("region")).toPandas().sort_values("region")["region"]
    spec = {"dimensions": {"region": {"dtype": "int"}}, "parameters": {"k": {}} | {n: {"dims": ["region"]} for n in ("m", "q", "s", "t")}}
    keys = region.tolist()
    given = {"region": keys, "k": 3.0, "m": {x: 2.0 * x for x in keys}, "q": [float(x) + 1 for x in keys], "s": (region * 10.0).set_axis(keys), "t": pa.table({"region": keys, "value": [x / 2 for x in keys]})}
    return api.evaluate(spark, spec, given, "k + m * q - s + t", ordered=False)


QUERIES["q_source_shapes"] = _shapes
ORACLE_SQL["q_source_shapes"] = "SELECT CAST(r_regionkey AS BIGINT) AS region, 3 + 2.0 * r_regionkey * (r_regionkey + 1) - r_regionkey * 10.0 + r_regionkey / 2.0 AS value FROM region"


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the door refuses, one broken table at a time."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.col("n_regionkey").cast("bigint").alias("region"))
    spec = {"dimensions": {"nation": {"dtype": "int"}, "region": {"dtype": "int"}}, "relations": {"of": {"key": "nation", "values": "region", "missing": "refused"}}, "parameters": {"a": {"dims": ["nation"]}}}
    a, keys = nation.select("nation", F.lit(1.0).alias("value")), [r[0] for r in nation.select("region").distinct().collect()]
    good = {"nation": nation.select("nation"), "region": keys, "of": nation, "a": a}
    cases = {
        "none": {},
        "duplicate label": {"nation": [0, 0]},
        "null label": {"region": [0, None]},
        "duplicate coordinate": {"a": a.unionAll(a)},
        "stray label": {"a": a.withColumn("nation", F.col("nation") + 1)},
        "null value": {"a": a.withColumn("value", F.expr("CASE WHEN nation = 3 THEN NULL ELSE value END"))},
        "nan value": {"a": a.withColumn("value", F.expr("CASE WHEN nation = 3 THEN double('NaN') ELSE value END"))},
        "missing row": {"a": a.filter("nation <> 3")},
        "wrong type": {"a": a.withColumn("value", F.lit("x"))},
        "missing column": {"a": a.select("value")},
        "key twice": {"of": nation.unionAll(nation)},
        "gap in a relation": {"of": nation.filter("nation <> 3")},
        "stray label in a relation": {"of": nation.withColumn("region", F.col("region") + 1)},
        "unknown source": {"b": 1.0},
    }
    found = []
    for case, broken in cases.items():
        try:
            door.attach(spark, program(spec), good | broken)
            found.append((case, False))
        except ModelError:
            found.append((case, True))
    return spark.createDataFrame(found, "broken string, refused boolean")


QUERIES["q_refused_tables"] = _refusals
ORACLE_SQL["q_refused_tables"] = "SELECT unnest(['none', 'duplicate label', 'null label', 'duplicate coordinate', 'stray label', 'null value', 'nan value', 'missing row', 'wrong type', 'missing column', 'key twice', 'gap in a relation', 'stray label in a relation', 'unknown source']) AS broken, broken <> 'none' AS refused"


# solved on the driver: small models with answers that SQL can tell

COVER = {"dimensions": {"nation": {"dtype": "int"}}, "parameters": {"need": {"dims": ["nation"]}, "cost": {"dims": ["nation"]}}, "variables": {"buy": {"dims": ["nation"], "bounds": {"lower": 0}}}, "expressions": {"spent": "buy * cost"}, "constraints": {"met": {"dims": ["nation"], "expression": "2 * buy >= need"}}, "objective": {"expression": "sum(spent)"}}


def _cover(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.col("n_regionkey").alias("region"))
    return COVER, {"nation": nation.select("nation"), "need": nation.select("nation", (F.col("nation") + 4).cast("double").alias("value"), "region"), "cost": nation.select("nation", (F.col("region") + 1).cast("double").alias("value"), "region")}


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, given = _cover(spark, sf_dir)
    result = api.solve(spark, spec, given)
    out = result.primal("buy").withColumnRenamed("value", "buy")
    for name, frame in (("dual", result.dual("met")), ("reduced_cost", result.reduced_cost("buy")), ("slack", result.slack("met")), ("activity", result.activity("met")), ("spent", result.evaluate("spent"))):
        out = out.join(frame.select("nation", F.round("value", 6).alias(name)), "nation")
    return out


QUERIES["q_solved"] = _solved
ORACLE_SQL["q_solved"] = "SELECT CAST(n_nationkey AS BIGINT) AS nation, (n_nationkey + 4) / 2.0 AS buy, (n_regionkey + 1) / 2.0 AS dual, 0.0::DOUBLE AS reduced_cost, 0.0::DOUBLE AS slack, (n_nationkey + 4)::DOUBLE AS activity, (n_nationkey + 4) / 2.0 * (n_regionkey + 1) AS spent FROM nation"


def _each_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per region, over the nations that it has."""
    spec, given = _cover(spark, sf_dir)
    given["nation"] = given["need"].select("nation", "region")
    return sweeps.solve_over(spark, spec, given, sweeps.EachLabel("region")).primal("buy").withColumnRenamed("value", "buy")


QUERIES["q_each_label"] = _each_region
ORACLE_SQL["q_each_label"] = "SELECT n_regionkey AS region, CAST(n_nationkey AS BIGINT) AS nation, (n_nationkey + 4) / 2.0 AS buy FROM nation"
