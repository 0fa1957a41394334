"""Published register files to long-format facts. Columns are found by name on the driver, rows stay in Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import to_int
from . import sheets

# fixed values: routes that allow sponsoring skilled workers
ROUTES = ["skilled worker", "global business mobility", "senior or specialist worker", "scale-up", "international sportsperson", "t2 minister of religion"]


def find_column(columns: list[str], *wanted: str) -> str:
    """The column whose letters and digits equal a candidate's, or else contain them; candidates in order."""
    key = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    exact = {key(c): c for c in columns}
    for w in wanted:
        if key(w) in exact:
            return exact[key(w)]
    for w in wanted:
        for k, c in exact.items():
            if key(w) and key(w) in k:
                return c
    raise KeyError(f"none of {wanted} among {columns}")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def _col(df: DataFrame, *wanted: str):
    return F.col(f"`{find_column(df.columns, *wanted)}`")


def _maybe(df: DataFrame, *wanted: str):
    """A column that a file may lack: null then, and for blank cells."""
    try:
        return F.nullif(F.btrim(_col(df, *wanted).cast("string")), F.lit(""))
    except KeyError:
        return F.lit(None).cast("string")


def _extra(**columns) -> Column:
    """What a file says besides, as a map of the cells that are filled."""
    return F.map_filter(F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c)]), lambda k, v: v.isNotNull()).alias("extra")


def petitions(df: DataFrame, published: str) -> DataFrame:
    """US petition rows: four counts a year, zeros kept in rows that have any figure."""
    metrics = {"initial_approvals": "Initial Approval", "initial_denials": "Initial Denial", "continuing_approvals": "Continuing Approval", "continuing_denials": "Continuing Denial"}
    rows = df.select(
        F.btrim(_col(df, "Employer (Petitioner) Name", "Employer")).alias("company_name"),
        to_int(_col(df, "Fiscal Year")).cast("int").alias("year"),
        *[to_int(_col(df, name)).alias(m) for m, name in metrics.items()],
        _extra(city=_maybe(df, "Petitioner City", "City"), state=_maybe(df, "Petitioner State", "State")),
    )
    some = F.exists(F.array(*metrics), lambda x: x != 0)
    rows = rows.where((F.col("company_name") != "") & (F.col("year") > 0) & some)
    return _facts(rows.unpivot(["company_name", "year", "extra"], list(metrics), "metric", "value"), "US", "us_petitions", published)


def register(df: DataFrame, published: str) -> DataFrame:
    """UK register: one flag per organisation, from its first row on a qualifying route; a blank route qualifies."""
    shown = _maybe(df, "Route", "Tier & Sub Tier", "Tier and Sub Tier")
    route = F.lower(F.coalesce(shown, F.lit("")))
    ok = (route == "") | F.exists(F.array(*map(F.lit, ROUTES)), lambda r: F.contains(route, r))
    extra = _extra(rating=_maybe(df, "Type & Rating", "Type and Rating", "Rating"), city=_maybe(df, "Town/City", "Town City", "Town"), route=shown)
    rows = df.select(F.btrim(_col(df, "Organisation Name")).alias("company_name"), ok.alias("ok"), extra, F.monotonically_increasing_id().alias("n")).where("ok and company_name <> ''")
    first = rows.groupBy("company_name").agg(F.min_by("extra", "n").alias("extra"))
    return _facts(first.select("company_name", F.lit(None).cast("int").alias("year"), F.lit("licensed_sponsor").alias("metric"), F.lit(1).alias("value"), "extra"), "GB", "uk_register", published)


def assessments(df: DataFrame, published: str) -> DataFrame:
    """Canadian assessments: positions and assessments summed by employer, positive figures only."""
    name = F.btrim(_col(df, "Employer"))
    counted = to_int(_maybe(df, "Approved LMIAs", "LMIAs Approved", "LMIAs"))
    province = _maybe(df, "Province/Territory", "Province Territory", "Province")
    province = F.when(F.lower(province) != "nan", province)
    rows = df.select(name.alias("company_name"), to_int(_col(df, "Approved Positions", "Positions")).alias("positions"), F.coalesce(counted, F.lit(0)).alias("assessments"), province.alias("province"), F.monotonically_increasing_id().alias("n"))
    rows = rows.where((F.col("company_name") != "") & ~F.lower("company_name").isin("nan", "total"))
    # of a company's rows with a province, the first one's
    first = F.min(F.when(F.col("province").isNotNull(), F.struct("n", "province")))["province"]
    sums = rows.groupBy("company_name").agg(F.sum("positions").alias("positions"), F.sum("assessments").alias("assessments"), first.alias("province"))
    sums = sums.select("company_name", "positions", "assessments", _extra(province=F.col("province")))
    facts = sums.unpivot(["company_name", "extra"], ["positions", "assessments"], "metric", "value").where("value > 0")
    return _facts(facts.withColumn("year", F.year(F.lit(published).cast("date"))), "CA", "ca_assessments", published)


def _facts(rows: DataFrame, country: str, source: str, published: str) -> DataFrame:
    return rows.select("company_name", F.lit(country).alias("country"), "year", "metric", F.col("value").cast("decimal(14,2)").alias("value"), F.lit(source).alias("source_id"), F.lit(published).cast("date").alias("published_date"), "extra")


def read_petitions(spark: SparkSession, path: str, published: str) -> DataFrame:
    return petitions(_csv(spark, path), published)


def read_register(spark: SparkSession, path: str, published: str) -> DataFrame:
    return register(_csv(spark, path), published)


def read_assessments(spark: SparkSession, path: str, published: str) -> DataFrame:
    """CSV or XLSX; the header is the first of 25 rows with a cell that starts with `employer`."""
    return assessments(read_table(spark, path, "employer"), published)


def read_table(spark: SparkSession, path: str, header_cell: str | None = None) -> DataFrame:
    """A file's table. A workbook's header is looked for; a CSV file's too if `header_cell` says what it starts with."""
    if header_cell or path.lower().endswith((".xlsx", ".xlsm")):
        return sheets.read_sheet(spark, path, header_cell or "employer")
    return _csv(spark, path)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Curated aliases: # lines and blank lines are skipped, all three cells are needed."""
    df = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select("canonical_name", "alias", F.upper("country").alias("country")).where("canonical_name <> '' and alias <> '' and country <> ''")


def discover(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, published): files that match a pattern, the newest date in each name, unknown where there is none."""
    found = spark.read.format("binaryFile").load(pattern).select("path")
    dated = F.regexp_extract_all("path", F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    return found.select("path", F.to_date(F.array_max(dated)).alias("published"))
