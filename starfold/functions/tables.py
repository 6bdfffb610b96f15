"""Table functions: search, trend and fit of series from SQL, on any table.

    SELECT * FROM box_search(TABLE(curve) PARTITION BY target_id ORDER BY time_days, key => 'target_id', flux => 'flux_norm', least_snr => 7.0D)

``key`` names the column that comes along in the result, of whatever type it is; ``time`` and ``flux`` name the series' columns
(time_days and flux otherwise). A partition is one series; it is held as two or three arrays. Rows with a null or non-finite
time or flux take no part. Options are constants, and an unknown one is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from starfold.operators import kernels as K


@dataclass
class Plan(AnalyzeResult):
    """What ``analyze`` has found: the columns to read, and the options."""

    columns: tuple = ()
    options: dict[str, Any] = field(default_factory=dict)


def _plan(rows: AnalyzeArgument, given: dict[str, AnalyzeArgument], defaults: dict[str, Any], result: T.StructType, more: tuple[str, ...] = ()) -> Plan:
    """Check a call, and put the key's type into the result's schema."""
    if not rows.isTable:
        raise ValueError("the first argument must be a TABLE")
    names = {"key": None, "time": "time_days", "flux": "flux"} | {m: None for m in more}
    if unknown := sorted(set(given) - set(names) - set(defaults)):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    for name, value in given.items():
        if not value.isConstantExpression:
            raise ValueError(f"{name} must be a constant")
    chosen = {k: given[k].value if k in given else v for k, v in names.items()}
    if chosen["key"] is None:
        raise ValueError("key must name the column that tells series apart")
    table = {f.name.lower(): f for f in rows.dataType.fields}
    for name, column in chosen.items():
        if column is not None and column.lower() not in table:
            raise ValueError(f"{name}: the table has no column {column}")
    key = table[chosen["key"].lower()]
    options = defaults | {k: v.value for k, v in given.items() if k in defaults}
    columns = tuple(None if c is None else table[c.lower()].name for c in chosen.values())
    return Plan(T.StructType([T.StructField(key.name, key.dataType), *result.fields]), columns=columns, options=options)


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "array<double>": T.ArrayType(T.DoubleType()), "array<string>": T.ArrayType(T.StringType())}


def _schema(fields: str) -> T.StructType:
    """Fields as in DDL; parsing that takes a session, which an import doesn't have."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


class _Series:
    """Collects a partition's rows."""

    def __init__(self, plan: Plan):
        self.columns, self.options, self.key = plan.columns, plan.options, None
        self.rows: list[tuple] = []

    def eval(self, row: Row, **options) -> Iterator[tuple]:
        key, time, flux, *more = self.columns
        self.key = row[key]
        t, x = row[time], row[flux]
        if t is not None and x is not None and np.isfinite(t) and np.isfinite(x):
            self.rows.append((float(t), float(x), *(None if m is None else row[m] for m in more)))
        return iter(())

    def arrays(self) -> list[np.ndarray]:
        """Time, flux and what else was asked for, in the order of time; rows of one time stay as they came."""
        columns = [np.array(c) for c in zip(*self.rows, strict=True)] or [np.zeros(0)] * len(self.columns[1:])
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]


_CANDIDATE = _schema("candidate int, period double, epoch double, duration double, depth double, events int, snr double, sde double, aliases array<double>, flags array<string>, status string")
_SEARCH = {"most": 2, "least_snr": 6.0, "least": 0.3, "largest": None, "least_duration": 0.5 / 24, "most_duration": 0.5, "durations": 15, "factor": 5.0, "budget": None, "fewest": 50}


class BoxSearch(_Series):
    """Candidates of each series, as ``search.candidates`` finds them; a series without any is one row with its status."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, **given: AnalyzeArgument) -> Plan:
        plan = _plan(rows, given, _SEARCH, _CANDIDATE)
        numbers = {k: v for k, v in plan.options.items() if v is not None}
        if any(not float(v) > 0 for v in numbers.values()):
            raise ValueError("options of a search must be positive")
        return plan

    def terminate(self) -> Iterator[tuple]:
        if self.key is None and not self.rows:
            return
        o = {k: float(v) if k in ("least_snr", "least", "largest", "least_duration", "most_duration", "factor") and v is not None else v for k, v in self.options.items()}
        t, x = self.arrays()
        grid = K.Grid(o["least"], o["largest"], o["least_duration"], o["most_duration"], o["durations"], o["factor"], o["budget"])
        found, status = K.find_candidates(t, x, None, o["most"], o["least_snr"], grid, o["fewest"])
        for c in found:
            yield (self.key, *(c[f.name] for f in _CANDIDATE.fields[:-1]), status)
        if not found:
            yield (self.key, *[None] * (len(_CANDIDATE) - 1), status)


_TREND = _schema("row long, time double, segment int, trend double, flux_detrended double")


class SlidingTrend(_Series):
    """The biweight trend of each row, within segments that gaps longer than ``gap`` part; ``row`` is the ``id`` column's value, or the row's place in its series."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, **given: AnalyzeArgument) -> Plan:
        plan = _plan(rows, given, {"window": 0.75, "gap": 0.25}, _TREND, ("id",))
        if not float(plan.options["window"]) > 0 or not float(plan.options["gap"]) > 0:
            raise ValueError("window and gap must be positive")
        return plan

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        t, x, ids = self.arrays()
        segment = np.concatenate([[0], np.cumsum(np.diff(t) > float(self.options["gap"]))])
        flat, trend = K.detrend(t, x, segment, float(self.options["window"]))
        names = range(len(t)) if self.columns[3] is None else ids.tolist()
        for row in zip(names, t.tolist(), segment.tolist(), trend.tolist(), flat.tolist(), strict=True):
            yield (self.key, *row)


_FIT = _schema("epoch double, period double, depth double, duration double, ingress double, chi2 double, bic double, status string")
_START = ("epoch", "period", "depth", "duration")


class TrapezoidFit(_Series):
    """A trapezoid fitted to each series, from the start values in the columns ``epoch``, ``period``, ``depth`` and ``duration`` of its first row."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, **given: AnalyzeArgument) -> Plan:
        table = {f.name.lower(): f.name for f in rows.dataType.fields} if rows.isTable else {}
        if lacking := [c for c in _START if c not in table]:
            raise ValueError(f"the table has no columns of start values: {', '.join(lacking)}")
        plan = _plan(rows, given, {}, _FIT)
        plan.columns += tuple(table[c] for c in _START)
        return plan

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        t, x, *start = self.arrays()
        first = [c[0] for c in start]
        if any(v is None for v in first):
            yield (self.key, *[None] * 7, "no_start_values")
            return
        error = np.full(len(x), max(K.MAD * np.median(np.abs(x - np.median(x))), 1e-6))
        try:
            fit = K.fit_trapezoid(t, x, error, *map(float, first))
        except (ValueError, np.linalg.LinAlgError) as why:
            yield (self.key, *[None] * 7, f"failed: {why}")
            return
        values = (fit.epoch, fit.period, fit.depth, fit.duration, fit.ingress, fit.chi2, fit.bic)
        yield (self.key, *map(float, values), "fitted" if fit.converged else "not_converged")


FUNCTIONS = {"box_search": BoxSearch, "sliding_trend": SlidingTrend, "trapezoid_fit": TrapezoidFit}


def register(spark: SparkSession) -> SparkSession:
    """Make the table functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
    return spark
