"""Quarterly adverse-event report files: ``$``-delimited text whose headers vary between quarters."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import names, rules
from apothecary.operators.dedup import latest_version
from apothecary.sources.tables import resolve_columns

_QUARTER = r"(?i)(\d{4}Q[1-4])"
#: Roles of drugs that are suspected: fixed values.
SUSPECT_ROLES = ("PS", "SS", "I")


def quarter_of_path(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, rf"{_QUARTER}/[^/]*$", 1))


def read_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table of one or more quarters, all text, with a lower-case header and the quarter of the folder.

    Files with different headers are united by name; columns that a quarter
    lacks are null. A row too short is filled, one too long is cut.
    """
    out = None
    for path in paths:
        df = spark.read.options(sep="$", header=True, encoding="ISO-8859-1", quote="", mode="PERMISSIVE").csv(path)
        df = df.select("*", quarter_of_path(F.col("_metadata.file_path")).alias("quarter"))
        df = df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


#: Kinds of a quarter's files, by how a file's name begins: fixed values.
KINDS = ("demo", "drug", "reac", "outc", "indi")
FAILURES = "quarter string, kind string, path string, reason string"


def discover_quarters(spark: SparkSession, folder: str) -> DataFrame:
    """quarter, kind and path of each file to read below ``folder``.

    Quarters are its folders of four digits, Q and 1 to 4, in either case. A
    file's kind is told by how its name begins, in either case. Of a name that
    is there as .txt and .csv the latter counts; of several names of a kind
    those with a .txt come first, then the least. Only names are listed, by
    Spark, so the folder may lie on any file system; no content is read. Empty
    files are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(f"{folder}/*/*").select("path")
    parts = F.regexp_extract("path", r"(?i)/(\d{4}q[1-4])/([^/]+)\.(?:txt|csv)$", 1), F.lower(F.regexp_extract("path", r"/([^/]+)\.[^./]+$", 1))
    rows = files.select("path", parts[0].alias("quarter"), parts[1].alias("stem"), F.lower(F.right("path", F.lit(3))).alias("type")).where("quarter <> ''")
    stems = rows.groupBy("quarter", "stem").agg(F.min_by("path", F.struct("type", "path")).alias("path"), F.max(F.col("type") == "txt").alias("has_txt"))
    kinds = stems.withColumn("kind", F.left("stem", F.lit(4))).where(F.col("kind").isin(*KINDS))
    return kinds.groupBy("quarter", "kind").agg(F.min_by("path", F.struct(~F.col("has_txt"), "stem")).alias("path")).select(F.upper("quarter").alias("quarter"), "kind", "path")


def read_quarters(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Of each kind found one table of all quarters, and a table of what is missing or could not be read.

    A quarter that lacks a kind, and a file that Spark can't open or that has
    no header or no report number (demographics, drugs, reactions, outcomes),
    is a row of the second table with its reason; the others are still read.
    The driver holds a row a file, as many as there are quarters times kinds.
    """
    found = {(r["quarter"], r["kind"]): r["path"] for r in discover_quarters(spark, folder).collect()}
    good: dict[str, list[str]] = {}
    failed = []
    for quarter in sorted({q for q, _ in found}):
        for kind in KINDS:
            path = found.get((quarter, kind))
            reason = "missing or empty" if path is None else _unfit(spark, path)
            if reason is None:
                good.setdefault(kind, []).append(path)
            else:
                failed.append((quarter, kind, path, reason))
    return {kind: read_reports(spark, paths) for kind, paths in good.items()}, spark.createDataFrame(failed, FAILURES)


def _unfit(spark: SparkSession, path: str) -> str | None:
    try:
        columns = {c.strip().lower() for c in read_reports(spark, [path]).columns} - {"quarter"}
    except (AnalysisException, SparkRuntimeException, Py4JJavaError) as error:
        return f"unreadable: {str(error).splitlines()[0]}"
    if not columns:
        return "no header"
    return None if columns & {"primaryid", "isr"} else "no report number"


def demographics(raw: DataFrame) -> DataFrame:
    """report, case_id, version, age in years, sex and country: the latest version of each case.

    Number, case and sex have other names in older quarters; each row has those of its own.
    """
    for name, known in (("_id", ("primaryid", "isr")), ("_case", ("caseid", "case")), ("_sex", ("sex", "gndr_cod"))):
        if found := [F.col(c) for c in known if c in raw.columns]:
            raw = raw.withColumn(name, F.coalesce(*found))
    wanted = {"report": ["_id"], "case_id": ["_case"], "version": ["caseversion"], "age": ["age"], "age_unit": ["age_cod"], "sex": ["_sex"], "country": ["reporter_country"], "quarter": ["quarter"]}
    df = resolve_columns(raw, wanted, required=("report",)).where("report is not null")
    if "age" in df.columns:
        unit = F.col("age_unit") if "age_unit" in df.columns else F.lit("YR")
        df = df.withColumn("age_years", rules.age_years(F.col("age"), unit)).drop("age", "age_unit")
    if "case_id" in df.columns:
        version = F.col("version").try_cast("double") if "version" in df.columns else F.lit(0.0)
        df = latest_version(df, "case_id", version, F.col("report"))
    return df


def drugs(raw: DataFrame) -> DataFrame:
    """report and drug of each suspected drug; every drug if the file has no roles."""
    raw = raw.withColumn("_id", F.coalesce(*[F.col(c) for c in ("primaryid", "isr") if c in raw.columns]))
    df = resolve_columns(raw, {"report": ["_id"], "drug": lambda c: "drugname" in c, "role": ["role_cod"]}, required=("report", "drug"))
    if "role" in df.columns:
        df = df.where(F.upper(F.trim("role")).isin(*SUSPECT_ROLES))
    return df.select("report", names.drug_name(F.col("drug")).alias("drug")).where("report is not null and drug <> ''")


def reactions(raw: DataFrame) -> DataFrame:
    raw = raw.withColumn("_id", F.coalesce(*[F.col(c) for c in ("primaryid", "isr") if c in raw.columns]))
    df = resolve_columns(raw, {"report": ["_id"], "event": ["pt"]}, required=("report", "event"))
    return df.select("report", F.upper(F.trim("event")).alias("event")).where("report is not null and event <> ''")


def outcomes(raw: DataFrame) -> DataFrame:
    raw = raw.withColumn("_id", F.coalesce(*[F.col(c) for c in ("primaryid", "isr") if c in raw.columns]))
    return resolve_columns(raw, {"report": ["_id"], "code": lambda c: c.startswith("outc_cod")}, required=("report", "code")).where("report is not null")
