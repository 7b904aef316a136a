"""CO2 savings per municipality and scenario.

Scenarios are a short list of ``Scenario`` records, or a table of them.  Address
rows are first reduced per municipality (combinable sums); only the reduced
rows are expanded to the scenarios: those of a list by ``explode`` of a literal
array, those of a table by a join on the household average.

Per address (one household each by default):

    household_co2 = households * avg * min(1, production / avg) * (grid - solar) * adoption
    car_co2       = diesel - electric from panels (share c) - electric from grid (1 - c)

NULL production (no yield for the municipality) gives NULL household savings,
which the sums skip.  The default ``km_driven`` is 0, which makes car savings
0, as in the original constants.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import MISSING, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import fresh_name, name_col
from ..functions.formulas import Scenario, car_co2_savings

# Column names of the original calculator accepted in a scenario table:
# its "population_treshold" is our ``adoption``; its ``cars`` is never used.
SCENARIO_ALIASES = {"population_treshold": "adoption"}
IGNORED_SCENARIO_COLUMNS = frozenset({"cars"})

# Scenario set of the registered query: the three adoption shares the original
# calculator prints, with driving distances so car savings are not all zero.
DEFAULT_SCENARIOS: tuple[Scenario, ...] = (
    Scenario("share_15", adoption=0.15),
    Scenario("share_30", adoption=0.30, km_driven=10_000.0),
    Scenario("share_90", adoption=0.90, km_driven=15_000.0, solar_coverage=0.8),
)


# Different household averages that a scenario table may have: each is a sum beside the others in every task.
MAX_AVERAGES = 1_000


def emission_savings(
    roofs: DataFrame,
    scenarios: Sequence[Scenario] | DataFrame = DEFAULT_SCENARIOS,
    *,
    production: str = "possible_kwh_per_year_whole_roof",
    group: str = "municipalityName",
) -> DataFrame:
    """Output: group, scenario, houses, production_kwh, household_co2_kg, car_co2_kg, total_co2_kg.

    ``scenarios``: records, or a table (see ``scenario_frame``).  Aggregate first,
    expand after.  The only per-row non-linearity is the coverage
    ``min(1, production / household_ykwh_average)``, so rows are reduced per
    (group, distinct average) to ``houses``, ``sum(production)`` and
    ``sum(coverage)`` (combinable sums; one literal average needs no explode at
    all), and only that small table is expanded to the scenarios:

        household_co2 = households * avg * sum(coverage) * (grid - solar) * adoption
        car_co2       = houses * (diesel - electric from panels - electric from grid)

    The distinct averages of a table are a scalar subquery, so nothing of it
    passes through the driver; more than ``MAX_AVERAGES`` of them stop the job.
    """
    p, g = name_col(production), name_col(group)

    def coverage(p: Column, a: Column) -> Column:
        return F.when(p > a, F.lit(1.0)).otherwise(p / a)

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("g", "avg").agg(F.count(F.lit(1)).alias("houses"), F.sum("p").alias("production_kwh"),
                                            F.sum("cov").alias("cov_sum"))

    def per_average(averages: Column) -> DataFrame:
        rows = roofs.select(g.alias("g"), p.alias("p"), F.explode(averages).alias("avg"))
        return rows.withColumn("cov", coverage(F.col("p"), F.col("avg")))

    if isinstance(scenarios, DataFrame):
        sc = scenario_frame(scenarios)
        averages = F.sort_array(F.collect_set("household_ykwh_average"))
        checked = F.when(F.size(averages) > MAX_AVERAGES, F.raise_error(F.lit(f"over {MAX_AVERAGES} household averages"))) \
            .otherwise(averages)
        reduced = sums(per_average(sc.agg(checked.alias("averages")).scalar()))
        expanded = reduced.join(sc.select(F.col("household_ykwh_average").alias("avg"),
                                          F.struct(*sc.columns).alias("s")), "avg")
    else:
        if not scenarios:
            raise ValueError("no scenarios")
        names = [s.name for s in scenarios]
        if len(set(names)) != len(names):
            raise ValueError("scenario names must be unique")
        averages = sorted({float(s.household_ykwh_average) for s in scenarios})
        if len(averages) == 1:
            a = F.lit(averages[0])
            rows = roofs.select(g.alias("g"), p.alias("p"), a.alias("avg"), coverage(p, a).alias("cov"))
        else:
            rows = per_average(F.array(*map(F.lit, averages)))
        expanded = sums(rows).select("*", F.explode(F.array(*[x.as_struct() for x in scenarios])).alias("s")) \
            .filter(F.col("s.household_ykwh_average") == F.col("avg"))
    s = F.col("s")
    household = s["households"] * s["household_ykwh_average"] * F.col("cov_sum") * (s["zse_co2"] - s["solar_co2"]) * s["adoption"]
    car = F.col("houses").cast("double") * car_co2_savings(s)
    out = expanded.select(F.col("g").alias(group), s["name"].alias("scenario"), "houses", "production_kwh",
                          household.alias("household_co2_kg"), car.alias("car_co2_kg"))
    return out.withColumn("total_co2_kg", F.coalesce("household_co2_kg", F.lit(0.0)) + F.col("car_co2_kg"))


def scenario_frame(table: DataFrame) -> DataFrame:
    """The ``Scenario`` fields of a table with ``name``, ``adoption`` and any of the others.

    A missing column or NULL means the field's default; the original
    calculator's names are accepted.  A name that occurs twice stops the job, a
    NULL adoption gives NULL savings.
    """
    known = {f.name: f for f in fields(Scenario)}
    given = {SCENARIO_ALIASES.get(c, c): c for c in table.columns if c not in IGNORED_SCENARIO_COLUMNS}
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"unknown scenario columns: {sorted(unknown)}")
    absent = [n for n, f in known.items() if f.default is MISSING and n not in given]
    if absent:
        raise ValueError(f"a scenario table needs {absent}")
    columns = []
    for n, f in known.items():
        value = name_col(given[n]).cast("string" if n == "name" else "double") if n in given else F.lit(None).cast("double")
        columns.append((value if f.default is MISSING else F.coalesce(value, F.lit(f.default))).alias(n))
    times = fresh_name(known, "times")
    named = table.select(*columns).withColumn(times, F.count(F.lit(1)).over(Window.partitionBy("name")))
    once = F.when(F.col(times) > 1, F.raise_error(F.concat(F.lit("two scenarios are named "), F.col("name")))) \
        .otherwise(F.col("name"))
    return named.withColumn("name", once).drop(times)
