"""Binding of the driver's tables to the domain registers.

The domain data (address registers, panel catalogue, irradiance logger, yield
replies) is not available here, so each domain table is derived from a driver
table of the same shape.  Every derivation exists twice: as DataFrame code
(used by the registered queries) and as a DuckDB SQL fragment (used by the
oracle).  Both read whole tables.

    entrances      <- orders    (o_orderkey id, o_custkey building link,
                                 o_orderstatus postal code, o_orderdate changedAt;
                                 coordinates are text '48.<custkey>' / '17.<orderkey>',
                                 'None' for pending orders / low priority)
    buildings      <- customer  (c_custkey id, c_mktsegment type, c_nationkey link;
                                 a version, dated, per urgent order of the customer)
    municipalities <- nation
    catalogue      <- part      (model name, STC watts, technology by type)
    readings       <- events    (ts, value)
    replies        <- pages     (html of every page, which belongs to the nation
                                 page_id % 25, plus a 'Year' line for https pages)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_model_name


_TABLES: dict[tuple, tuple[tuple, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name`` under ``sf_dir``, defined once per session and state of its path.

    Defining a Parquet table lists its files and reads a footer; the
    DataFrame (a plan, not data) is kept and reused by later queries, as a
    catalog table would be, until the file or folder is another one (by length
    and time of change).  Every query still scans the files.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (id(spark), spark.sparkContext.applicationId, path.toString())
    state = (status.getModificationTime(), status.getLen())
    known = _TABLES.get(key)
    if known is None or known[0] != state:
        known = _TABLES[key] = (state, spark.read.parquet(path.toString()))
    return known[1]


# -- query parameters for the stand-ins --------------------------------------
STANDIN_BUILDING_TYPES = ("BUILDING", "HOUSEHOLD")
STANDIN_CITY = "nation_1"
# Stand-in technology per part type; LARGE maps to a technology the service
# does not know, so the default code is exercised.
STANDIN_TECHNOLOGY = {
    "ECONOMY": "Mono-c-Si",
    "SMALL": "Multi-c-Si",
    "MEDIUM": "Thin Film",
    "PROMO": "CdTe",
    "STANDARD": "CIGS",
    "LARGE": "HIT-Si",
}


# -- registers ---------------------------------------------------------------
def entrances(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("objectId"),
        F.col("o_orderstatus").alias("postalCode"),
        F.when(F.col("o_orderstatus") == "P", F.lit("None"))
        .otherwise(F.concat(F.lit("48."), F.col("o_custkey").cast("string"))).alias("axisB"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("None"))
        .otherwise(F.concat(F.lit("17."), F.col("o_orderkey").cast("string"))).alias("axisL"),
        F.col("o_custkey").alias("propertyRegistrationNumberIdentifier"),
        F.col("o_orderdate").alias("changedAt"),
    )


ENTRANCES_SQL = """
SELECT o_orderkey AS objectId,
       o_orderstatus AS postalCode,
       CASE WHEN o_orderstatus = 'P' THEN 'None' ELSE '48.' || CAST(o_custkey AS VARCHAR) END AS axisB,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'None' ELSE '17.' || CAST(o_orderkey AS VARCHAR) END AS axisL,
       o_custkey AS propertyRegistrationNumberIdentifier,
       o_orderdate AS changedAt
FROM orders"""


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a building, one version per urgent order of its, dated by it (undated if none)."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT") \
        .select("o_custkey", F.col("o_orderdate").alias("changedAt"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(
        F.col("c_custkey").alias("objectId"),
        F.col("c_mktsegment").alias("buildingTypeName"),
        F.col("c_custkey").alias("propertyRegistrationNumber"),
        F.col("c_nationkey").alias("municipalityIdentifier"),
        "changedAt",
    )


BUILDINGS_SQL = """
SELECT c_custkey AS objectId, c_mktsegment AS buildingTypeName,
       c_custkey AS propertyRegistrationNumber, c_nationkey AS municipalityIdentifier,
       u.o_orderdate AS changedAt
FROM customer LEFT JOIN (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT') u
     ON c_custkey = u.o_custkey"""


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("objectId"), F.col("n_name").alias("municipalityName"))


MUNICIPALITIES_SQL = "SELECT n_nationkey AS objectId, n_name AS municipalityName FROM nation"


# -- the address table (flagship) as SQL --------------------------------------
ADDRESS_ORDER_SQL = ("changedAt DESC NULLS LAST, entranceObjectId, postalCode NULLS FIRST, "
                     "propertyRegistrationNumber NULLS FIRST, municipalityName NULLS FIRST, "
                     "buildingTypeName NULLS FIRST, houseObjectId NULLS FIRST, addressObjectId NULLS FIRST")


def _addresses_sql(dated: str) -> str:
    """``dated``: the table (e or b) whose changedAt counts."""
    return f"""
WITH e AS ({ENTRANCES_SQL}),
     b AS ({BUILDINGS_SQL}),
     m AS ({MUNICIPALITIES_SQL}),
     j AS (
       SELECT e.objectId AS entranceObjectId, e.postalCode,
              nullif(e.axisB, 'None') AS axisB, nullif(e.axisL, 'None') AS axisL,
              b.objectId AS houseObjectId, b.buildingTypeName, {dated}.changedAt,
              b.propertyRegistrationNumber, m.objectId AS addressObjectId, m.municipalityName
       FROM e JOIN b ON e.propertyRegistrationNumberIdentifier = b.objectId
              JOIN m ON b.municipalityIdentifier = m.objectId
       WHERE nullif(e.axisB, 'None') IS NOT NULL AND nullif(e.axisL, 'None') IS NOT NULL),
     r AS (
       SELECT *, row_number() OVER (
                   PARTITION BY postalCode, propertyRegistrationNumber, municipalityName,
                                buildingTypeName, houseObjectId, addressObjectId
                   ORDER BY changedAt DESC NULLS LAST, entranceObjectId, axisB, axisL) AS rn
       FROM j)
SELECT entranceObjectId, postalCode, axisB, axisL, houseObjectId, buildingTypeName, changedAt,
       propertyRegistrationNumber, addressObjectId, municipalityName, CAST(140 AS INTEGER) AS area
FROM r
WHERE rn = 1
  AND buildingTypeName IN ('BUILDING', 'HOUSEHOLD')
  AND strpos(lower(municipalityName), 'nation_1') > 0"""


ADDRESSES_SQL = _addresses_sql("b")
ENTRANCE_DATED_SQL = _addresses_sql("e")


# -- catalogue -----------------------------------------------------------------
def _technology_sql(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STANDIN_TECHNOLOGY.items())
    return f"CASE {col} {whens} END"


def technology_col(col: str = "p_type"):
    expr = None
    for k, v in STANDIN_TECHNOLOGY.items():
        cond = F.col(col) == k
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def raw_model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model names as a user would type them: brand, '(type) ', product name."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat_ws(" ", "p_brand", F.concat(F.lit("("), "p_type", F.lit(")")), "p_name")
                    .alias("raw_name"))


RAW_MODEL_NAMES_SQL = "SELECT p_partkey, p_brand || ' (' || p_type || ') ' || p_name AS raw_name FROM part"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel catalogue: unique normalised name, STC watts, technology."""
    p = table(spark, sf_dir, "part")
    return p.select(
        normalise_model_name(F.concat_ws(" ", "p_brand", "p_name", F.col("p_partkey").cast("string")))
        .alias("panel_name"),
        F.col("p_retailprice").alias("STC"),
        technology_col().alias("Technology"),
    )


CATALOGUE_SQL = f"""
SELECT regexp_replace(regexp_replace(p_brand || ' ' || p_name || ' ' || CAST(p_partkey AS VARCHAR),
                                     '\\(.*\\) ', '', 'g'), '[.\\-\\s]', '_', 'g') AS panel_name,
       p_retailprice AS STC,
       {_technology_sql('p_type')} AS Technology
FROM part"""


def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct requested model names: brand + first or last word of a part name.

    First words start catalogue names of that brand; last words mostly do not,
    so both found and unknown models occur.
    """
    p = table(spark, sf_dir, "part")
    words = p.select("p_brand", "p_type", F.explode(F.array(
        F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1))).alias("word"))
    raw = F.concat_ws(" ", "p_brand", F.concat(F.lit("("), "p_type", F.lit(")")), "word")
    return words.select(normalise_model_name(raw).alias("request_name")).distinct()


MODEL_REQUESTS_SQL = """
SELECT DISTINCT regexp_replace(regexp_replace(p_brand || ' (' || p_type || ') ' || w,
                                              '\\(.*\\) ', '', 'g'), '[.\\-\\s]', '_', 'g') AS request_name
FROM (SELECT p_brand, p_type, split_part(p_name, ' ', 1) AS w FROM part
      UNION ALL
      SELECT p_brand, p_type, string_split(p_name, ' ')[-1] AS w FROM part)"""


# -- yield replies -------------------------------------------------------------
def _reply_body():
    year_line = F.concat(F.lit("\nYear    "), F.length("html").cast("string"), F.lit(".25\n"))
    return F.when(F.col("url").startswith("https"), F.concat("html", year_line)).otherwise(F.col("html"))


def page_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a reply text; https pages carry a 'Year' line."""
    pg = table(spark, sf_dir, "pages")
    return pg.select("page_id", _reply_body().alias("body"))


REPLY_BODY_SQL = ("CASE WHEN starts_with(url, 'https') "
                  "THEN html || chr(10) || 'Year    ' || CAST(length(html) AS VARCHAR) || '.25' || chr(10) "
                  "ELSE html END")
PAGE_REPLIES_SQL = f"SELECT page_id, {REPLY_BODY_SQL} AS body FROM pages"


def municipality_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by municipality: every page belongs to one, so a municipality has many."""
    pg = table(spark, sf_dir, "pages")
    n = table(spark, sf_dir, "nation")
    return (pg.join(n, F.pmod(pg["page_id"], F.lit(25)) == n["n_nationkey"].cast("bigint"), "inner")
            .select(F.col("n_name").alias("municipalityName"), _reply_body().alias("body")))


MUNICIPALITY_REPLIES_SQL = f"""
SELECT n_name AS municipalityName, {REPLY_BODY_SQL} AS body
FROM pages JOIN nation ON page_id % 25 = CAST(n_nationkey AS BIGINT)"""


def municipality_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested model per municipality: brand and first word of the parts that fall to it, smallest first."""
    p = table(spark, sf_dir, "part")
    n = table(spark, sf_dir, "nation")
    raw = F.concat_ws(" ", "p_brand", F.concat(F.lit("("), "p_type", F.lit(")")), F.substring_index("p_name", " ", 1))
    return (p.join(n, F.pmod(p["p_partkey"], F.lit(25)) == n["n_nationkey"].cast("bigint"), "inner")
            .groupBy(F.col("n_name").alias("municipalityName")).agg(F.min(normalise_model_name(raw)).alias("request_name")))


MUNICIPALITY_MODELS_SQL = """
SELECT n_name AS municipalityName,
       min(regexp_replace(regexp_replace(p_brand || ' (' || p_type || ') ' || split_part(p_name, ' ', 1),
                                         '\\(.*\\) ', '', 'g'), '[.\\-\\s]', '_', 'g')) AS request_name
FROM part JOIN nation ON p_partkey % 25 = CAST(n_nationkey AS BIGINT) GROUP BY n_name"""


# -- irradiance readings ---------------------------------------------------------
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", F.col("value").alias("watts"))
