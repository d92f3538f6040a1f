"""rowloom: optimisation models as relational data, on Spark DataFrames."""

from rowloom.api import Model, Result, build, check, evaluate, load_result, scan_result, solve, tidy, write
from rowloom.plans.spec import merge, without_sets
from rowloom.sweeps import EachLabel, EachWindow, Sweep, build_slice, load_sweep, solve_over

__all__ = ["EachLabel", "EachWindow", "Model", "Result", "Sweep", "build", "build_slice", "check", "evaluate", "load_result", "load_sweep", "merge", "scan_result", "solve", "solve_over", "tidy", "without_sets", "write"]
