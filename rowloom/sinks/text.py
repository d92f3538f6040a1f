"""LP and MPS text. Lines are made and ordered by Spark; a part file is a stretch of the whole in order."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.errors import SinkError
from rowloom.plans.assembly import Handoff

#: What the text formats can hold.
TEXT_TAKES = {"lp": {"integrality", "sos", "quadratic_objective", "quadratic_constraint"}, "mps": {"integrality", "sos"}}


def _number(v: Column) -> Column:
    """Shortest text that reads back to the same double; whole numbers without a point."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def _signed(v: Column) -> Column:
    return F.concat(F.when(v < 0, F.lit("- ")).otherwise(F.lit("+ ")), _number(F.abs(v)))


def _line(df: DataFrame, section: int, text: Column, *order: Column) -> DataFrame:
    keys = [*order, *[F.lit(0).cast("bigint")] * (3 - len(order))]
    return df.select(F.lit(section).alias("section"), *[k.cast("bigint").alias(f"k{i}") for i, k in enumerate(keys)], text.alias("value"))


def lp_lines(h: Handoff) -> DataFrame:
    """(section, k0, k1, k2, value): every line of the LP file with its order."""
    spark, col = h.attached.spark, lambda c="col": F.concat(F.lit("x"), F.col(c).cast("string"))
    head = lambda section, *texts: _line(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string"), section, F.col("t"), F.col("i"))
    sense = F.when(F.col("sense") == "==", "=").otherwise(F.col("sense"))
    parts = [
        head(0, "Minimize" if h.sense == "minimize" else "Maximize", " obj:"),
        _line(h.obj, 1, F.concat_ws(" ", _signed(F.col("coeff")), col()), F.col("col")),
        head(4, "Subject To"),
        _line(h.rows, 5, F.concat(F.lit(" c"), F.col("row").cast("string"), F.lit(":")), F.col("row"), F.lit(0)),
        _line(h.matrix, 5, F.concat_ws(" ", _signed(F.col("coeff")), col()), F.col("row"), F.lit(1), F.col("col")),
        _line(h.rows, 5, F.concat_ws(" ", F.lit(""), sense, _number(F.col("rhs"))), F.col("row"), F.lit(5)),
        head(6, "Bounds"),
        head(99, "End"),
    ]
    if h.constant:
        parts.append(head(3, f"+ {h.constant!r} one" if h.constant > 0 else f"- {-h.constant!r} one"))
        parts.append(head(7, " one = 1"))
    if "quadratic_objective" in h.kinds:  # in the format the bracket is halved
        twice = _signed(2 * F.col("coeff"))
        parts += [head(2, "+ ["), _line(h.quad, 2, F.concat_ws(" ", twice, F.when(F.col("col_l") == F.col("col_r"), F.concat(col("col_l"), F.lit(" ^ 2"))).otherwise(F.concat_ws(" * ", col("col_l"), col("col_r")))), F.col("col_l") + 1, F.col("col_r")), _line(spark.range(1), 2, F.lit("] / 2"), F.lit(2**62))]
    if "quadratic_constraint" in h.kinds:
        with_quad = h.qmatrix.select("row").distinct()
        parts += [
            _line(with_quad, 5, F.lit("+ ["), F.col("row"), F.lit(2)),
            _line(h.qmatrix, 5, F.concat_ws(" ", _signed(F.col("coeff")), F.when(F.col("col_l") == F.col("col_r"), F.concat(col("col_l"), F.lit(" ^ 2"))).otherwise(F.concat_ws(" * ", col("col_l"), col("col_r")))), F.col("row"), F.lit(3), F.col("col_l")),
            _line(with_quad, 5, F.lit("]"), F.col("row"), F.lit(4)),
        ]
    low = F.when(F.col("lb") == float("-inf"), F.lit("-inf")).otherwise(_number(F.col("lb")))
    high = F.when(F.col("ub") == float("inf"), F.lit("+inf")).otherwise(_number(F.col("ub")))
    free = (F.col("lb") == float("-inf")) & (F.col("ub") == float("inf"))
    parts.append(_line(h.cols, 8, F.when(free, F.concat(F.lit(" "), col(), F.lit(" free"))).otherwise(F.concat(F.lit(" "), F.concat_ws(" <= ", low, col(), high))), F.col("col")))
    for section, title, kind in ((10, "Binary", "binary"), (12, "General", "integer")):
        if "integrality" in h.kinds:
            parts += [head(section, title), _line(h.cols.filter(F.col("vtype") == kind), section + 1, F.concat(F.lit(" "), col()), F.col("col"))]
    if "sos" in h.kinds:
        parts += [head(20, "SOS"), _line(h.sos.groupBy("set").agg(F.first("type").alias("type")), 21, F.concat(F.lit(" s"), F.col("set").cast("string"), F.lit(": S"), F.col("type").cast("string"), F.lit("::")), F.col("set"), F.lit(0))]
        parts.append(_line(h.sos, 21, F.concat(F.lit("  "), col(), F.lit(":"), F.col("weight").cast("string")), F.col("set"), F.lit(1), F.col("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mps_lines(h: Handoff) -> DataFrame:
    """(section, k0, k1, k2, value): every line of the free-format MPS file, column by column."""
    spark, row = h.attached.spark, lambda: F.concat(F.lit("c"), F.col("row").cast("string"))
    col = F.concat(F.lit("x"), F.col("col").cast("string"))
    head = lambda section, *texts: _line(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string"), section, F.col("t"), F.col("i"))
    kind = F.when(F.col("sense") == "<=", "L").when(F.col("sense") == ">=", "G").otherwise("E")
    entries = h.matrix.select("col", "row", "coeff").unionByName(h.obj.select("col", F.lit(-1).cast("bigint").alias("row"), "coeff"))
    whole = h.cols.select("col", (F.col("vtype") != "continuous").alias("whole"))
    # integer columns stand between markers, each on its own
    body = _line(entries, 5, F.concat_ws(" ", F.lit(""), col, F.when(F.col("row") < 0, F.lit("obj")).otherwise(row()), _number(F.col("coeff"))), F.col("col"), F.lit(1), F.col("row"))
    parts = [head(0, "NAME model", *(["OBJSENSE", " MAX"] if h.sense == "maximize" else [])), head(1, "ROWS", " N obj"), _line(h.rows, 2, F.concat_ws(" ", F.lit(""), kind, row()), F.col("row")), head(4, "COLUMNS"), body]
    unused = h.cols.select("col").join(entries.select("col"), "col", "left_anti")
    parts.append(_line(unused, 5, F.concat_ws(" ", F.lit(""), col, F.lit("obj 0")), F.col("col"), F.lit(1)))
    if "integrality" in h.kinds:
        ints = whole.filter("whole")
        for word, at in (("INTORG", 0), ("INTEND", 2)):
            parts.append(_line(ints, 5, F.concat(F.lit(" M"), F.col("col").cast("string"), F.lit(f" 'MARKER' '{word}'")), F.col("col"), F.lit(at)))
    parts += [head(6, "RHS"), _line(h.rows.filter("rhs <> 0"), 7, F.concat_ws(" ", F.lit(" rhs"), row(), _number(F.col("rhs"))), F.col("row")), head(8, "BOUNDS"), head(99, "ENDATA")]
    if h.constant:
        parts.append(head(7, f" rhs obj {-h.constant!r}"))
    free = (F.col("lb") == float("-inf")) & (F.col("ub") == float("inf"))
    bound = lambda word, value=None: F.concat_ws(" ", F.lit(f" {word} bnd"), col, *([value] if value is not None else []))
    parts.append(_line(h.cols.filter(free), 9, bound("FR"), F.col("col"), F.lit(0)))
    parts.append(_line(h.cols.filter(~free & (F.col("lb") == float("-inf"))), 9, bound("MI"), F.col("col"), F.lit(0)))
    parts.append(_line(h.cols.filter((F.col("lb") > float("-inf")) & (F.col("lb") != 0)), 9, bound("LO", _number(F.col("lb"))), F.col("col"), F.lit(0)))
    parts.append(_line(h.cols.filter(F.col("ub") < float("inf")), 9, bound("UP", _number(F.col("ub"))), F.col("col"), F.lit(1)))
    parts.append(_line(h.cols.filter((F.col("vtype") != "continuous") & (F.col("ub") == float("inf"))), 9, bound("PL"), F.col("col"), F.lit(1)))
    if "sos" in h.kinds:
        parts += [head(20, "SOS"), _line(h.sos.groupBy("set").agg(F.first("type").alias("type")), 21, F.concat(F.lit(" S"), F.col("type").cast("string"), F.lit(" SOS s"), F.col("set").cast("string")), F.col("set"), F.lit(0))]
        parts.append(_line(h.sos, 21, F.concat_ws(" ", F.lit(""), F.lit("SOS"), col, F.col("weight").cast("string")), F.col("set"), F.lit(1), F.col("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write(h: Handoff, path, *, single: bool = True) -> str:
    """Write a model as .lp or .mps; `single` streams the ordered lines into one file, else the path is a folder of part files in order."""
    kind = str(path).rsplit(".", 1)[-1]
    if kind not in TEXT_TAKES:
        raise SinkError(f"{path}: the name must end in .lp or .mps")
    if beyond := h.kinds - TEXT_TAKES[kind]:
        raise SinkError(f"{kind} text can't hold {', '.join(sorted(beyond))}")
    lines = (lp_lines if kind == "lp" else mps_lines)(h).orderBy("section", "k0", "k1", "k2").select("value")
    if single:
        with Path(path).open("w", encoding="utf-8") as f:
            f.writelines(f"{r[0]}\n" for r in lines.toLocalIterator())
    else:
        lines.write.mode("overwrite").text(str(path))
    return str(path)
