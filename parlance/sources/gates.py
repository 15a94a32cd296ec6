"""Gate suites from a JSON file: {"suite": [{"metric": ..., "max": ..., "min": ..., "eq": ..., "tol": ...}, ...]}, or
{"schema": ..., "suites": {"suite": {"description": ..., "gates": [...]}}}."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession

CHECK = "suite string, metric string, max double, min double, eq double, tol double"
BOUNDS = ("max", "min", "eq", "tol")


def checks_of(suites: dict) -> list[tuple]:
    """Rows of suites; unknown keys, checks without a bound, bounds that aren't finite numbers and
    bounds the wrong way round are refused."""
    rows = []
    for suite, checks in suites.items():
        if not isinstance(checks, list) or not checks:
            raise ValueError(f"{suite}: a suite is a list of checks")
        for n, c in enumerate(checks):
            where = f"{suite}[{n}]"
            if not isinstance(c, dict) or not isinstance(c.get("metric"), str):
                raise ValueError(f"{where}: a check has a metric")
            if unknown := set(c) - {"metric", *BOUNDS}:
                raise ValueError(f"{where}: unknown {', '.join(sorted(unknown))}")
            for key in BOUNDS:
                if key in c and (isinstance(c[key], bool) or not isinstance(c[key], (int, float)) or not math.isfinite(c[key])):
                    raise ValueError(f"{where}: {key} isn't a finite number")
            if not {"max", "min", "eq"} & set(c):
                raise ValueError(f"{where}: no max, min or eq")
            if "max" in c and "min" in c and c["min"] > c["max"]:
                raise ValueError(f"{where}: min is above max")
            tol = c.get("tol", 0)
            if tol < 0:
                raise ValueError(f"{where}: tol is negative")
            if "eq" in c and (c["eq"] + tol < c.get("min", -math.inf) - tol or c["eq"] - tol > c.get("max", math.inf) + tol):
                raise ValueError(f"{where}: eq is outside of min and max")
            rows.append((suite, c["metric"], *(float(c[k]) if k in c else None for k in BOUNDS)))
    return rows


def suites_of(data: dict, schema: str | None = None) -> dict:
    """The lists of checks of either layout, and of ``schema`` if it is given."""
    if not isinstance(data, dict) or not data:
        raise ValueError("suites are an object that isn't empty")
    if schema is not None and data.get("schema") != schema:
        raise ValueError(f"the schema is {data.get('schema')}, not {schema}")
    if "suites" not in data:
        return data
    if unknown := set(data) - {"schema", "suites"}:
        raise ValueError(f"unknown {', '.join(sorted(unknown))}")
    if not isinstance(data["suites"], dict) or not data["suites"]:
        raise ValueError("suites are an object that isn't empty")
    found = {}
    for name, body in data["suites"].items():
        if not isinstance(body, dict) or set(body) - {"description", "gates"}:
            raise ValueError(f"{name}: a suite has gates and a description")
        found[name] = body.get("gates")
    return found


def read(spark: SparkSession, path: str, suite: str | None = None) -> DataFrame:
    suites = suites_of(json.loads(spark.read.text(path, wholetext=True).first()[0]))
    if suite is not None and suite not in suites:
        raise ValueError(f"no suite {suite}; there are {', '.join(sorted(suites))}")
    return spark.createDataFrame(checks_of(suites if suite is None else {suite: suites[suite]}), CHECK)
