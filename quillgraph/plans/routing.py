"""Where a question goes next, as columns over its state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def after_planning(query: Column, attempt: Column, n_entry: Column, n_context: Column) -> Column:
    return (
        F.when(F.coalesce(query, F.lit("")) != "", "run")
        .when(~attempt.eqNullSafe(F.lit("intersection")), "abort")
        .when((n_entry == 0) & (n_context > 0), "context_explore")
        .when(n_entry == 0, "abort")
        .otherwise("fallback")
    )


def after_execution(error: Column, attempt: Column, n_rows: Column) -> Column:
    broken = F.coalesce(error, F.lit("")) != ""
    retry = error.rlike("SyntaxError|Invalid") & ~attempt.isin("fallback", "reformulation")
    return F.when(broken, F.when(retry, "retry").otherwise("answer")).when(n_rows > 0, "evaluate").when(attempt == "intersection", "retry").otherwise("answer")


def after_evaluation(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "synthesize").otherwise("reformulate")


def verdict_ok(text: Column) -> Column:
    """Whether a written verdict is good: its first line doesn't start with POOR; nothing written is good."""
    return ~F.upper(F.trim(F.get(F.split(F.coalesce(text, F.lit("")), "\n"), F.lit(0)))).startswith("POOR")
