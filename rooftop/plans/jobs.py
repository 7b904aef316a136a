"""Table jobs: a function from input DataFrames to output DataFrames, bound to
declared tables.

    run_job(spark, fn, inputs={"houses": TableIn(...)}, outputs={"out": TableOut(...)})

An input is anything with a ``path`` and ``read(spark)``, an output anything with a
``path`` and ``write(df)``: besides ``TableIn`` and ``TableOut`` the deliveries of a
table, a stamped table as of a time, and an append that counts once.

The declared paths are checked before anything is read: one path used twice as
input (or twice as output) is a collision, a path used as input and output is
a cycle.  ``fn(spark, **frames)`` returns one DataFrame (when there is one
output), a dict of them by output name, or None.  It is called once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import TableIn, TableOut


class PathCollisionError(ValueError):
    """The same path is declared twice on one side of a job."""


class CyclicDependencyError(ValueError):
    """A job reads and writes the same path."""


def check_paths(inputs: Mapping[str, TableIn], outputs: Mapping[str, TableOut]) -> None:
    read = Counter(t.path for t in inputs.values())
    written = Counter(t.path for t in outputs.values())
    repeated = sorted(p for p, n in [*read.items(), *written.items()] if n > 1)
    if repeated:
        raise PathCollisionError(f"declared twice on one side: {repeated}")
    both = sorted(read.keys() & written.keys())
    if both:
        raise CyclicDependencyError(f"both input and output: {both}")


def run_job(
    spark: SparkSession,
    fn: Callable[..., DataFrame | Mapping[str, DataFrame] | None],
    inputs: Mapping[str, TableIn] | None = None,
    outputs: Mapping[str, TableOut] | None = None,
    preview: int = 0,
) -> dict[str, DataFrame]:
    """Check paths, read inputs, call ``fn`` once, write its outputs.

    ``preview`` > 0 shows that many rows of each output before writing (this
    runs the plan a second time, so it is off by default).
    """
    inputs = dict(inputs or {})
    outputs = dict(outputs or {})
    check_paths(inputs, outputs)
    frames = {name: t.read(spark) for name, t in inputs.items()}
    result = fn(spark, **frames)
    if result is None:
        produced: dict[str, DataFrame] = {}
    elif isinstance(result, DataFrame):
        if len(outputs) != 1:
            raise ValueError("a job returning one DataFrame needs exactly one output")
        produced = {next(iter(outputs)): result}
    else:
        produced = dict(result)
    unknown = set(produced) - set(outputs)
    if unknown:
        raise ValueError(f"job returned undeclared outputs: {sorted(unknown)}")
    for name, df in produced.items():
        if preview > 0:
            df.show(preview, truncate=False)
        outputs[name].write(df)
    return produced


def table_job(outputs: Mapping[str, TableOut] | TableOut | None = None, **inputs: TableIn):
    """Decorator form: ``@table_job(TableOut(...), houses=TableIn(...))`` then ``job(spark)``, or
    ``job(spark, preview=n)`` to show rows of each output.  The declared tables are ``job.inputs`` and ``job.outputs``."""
    outs = {"out": outputs} if isinstance(outputs, TableOut) else dict(outputs or {})

    def deco(fn):
        def run(spark: SparkSession, preview: int = 0) -> dict[str, DataFrame]:
            return run_job(spark, fn, inputs, outs, preview=preview)
        run.inputs, run.outputs = dict(inputs), outs
        run.__name__ = getattr(fn, "__name__", "job")
        run.__doc__ = fn.__doc__
        return run
    return deco
