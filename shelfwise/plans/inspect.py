"""Reading physical plans: what ``explain`` shows, as text, for checks and tests."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

# Physical operators that mean rows cross into Python.
PYTHON_OPERATORS = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                    "FlatMapCoGroupsInPandas", "PythonUDF", "MapInArrow")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def python_operators(df: DataFrame) -> list[str]:
    text = plan_text(df, "extended")
    return [op for op in PYTHON_OPERATORS if op in text]


def pushed_filters(df: DataFrame) -> list[str]:
    """The ``PushedFilters`` lines of every Parquet scan in the plan."""
    return [line.strip() for line in plan_text(df).splitlines() if line.strip().startswith("PushedFilters")]
