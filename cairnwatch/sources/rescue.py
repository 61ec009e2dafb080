"""Catalogue files read with their bad rows kept beside the good ones: which file, which row, and why.

A row is bad if the file's form is broken there (too many or too few fields, broken JSON) or
if it breaks a rule of its catalogue. Good rows go through the same functions as in catalogs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnwatch.functions import text as tx
from cairnwatch.functions.dates import flexible_date
from cairnwatch.sources import catalogs
from cairnwatch.sources.catalogs import first

CORRUPT = "_corrupt"
REJECTED = "file string, row string, reasons array<string>"


def csv_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A CSV file's rows as strings, with the text of a row that has not as many fields as the header in CORRUPT, and its file.

    Unless `lines`, a row is a line and large files are read by many tasks.
    """
    options = {"header": True, "multiLine": lines, "quote": '"', "escape": '"'}
    names = spark.read.csv(path, **options).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    # With columns pruned, the reader wouldn't count a row's fields.
    return spark.read.schema(schema).option("columnPruning", False).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True, **options).withColumn("_file", F.input_file_name())


def parted(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows that hold all rules (a reason each, and what must be true), and REJECTED of the others.

    A rule that can't be decided (null) counts as broken; of a row of broken form no rule is asked.
    """
    names = [c for c in rows.columns if c not in (CORRUPT, "_file")]
    broken = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("malformed row"))).otherwise(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in rules.items()])))
    told = rows.withColumn("_reasons", broken)
    good = told.where(F.size("_reasons") == 0).select(*[F.col(f"`{n}`") for n in names])
    shown = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])))
    return good, told.where(F.size("_reasons") > 0).select(F.element_at(F.split("_file", "/"), -1).alias("file"), shown.alias("row"), F.col("_reasons").alias("reasons"))


def _dated(c: Column) -> Column:
    return (F.trim(c) == "") | (flexible_date(c) != "")


def _kev(df: DataFrame) -> dict[str, Column]:
    cve = F.upper(F.trim(first(df, "cveID", "cve_id", "cve")))
    return {"bad vulnerability id": cve.rlike(r"^(CVE-)?\d{4}-\d{4,7}$"), "bad date": _dated(first(df, "dateAdded", "date_added")) & _dated(first(df, "dueDate", "due_date"))}


def _mapping(df: DataFrame) -> dict[str, Column]:
    return {"bad vulnerability id": first(df, "capability_id", "cve_id", "cve").rlike(r"CVE-\d+-\d+"), "bad technique id": F.trim(first(df, "attack_object_id", "technique_id")).rlike(r"^T\d{4}(\.\d{3})?$")}


def _feed(df: DataFrame) -> dict[str, Column]:
    number = lambda *n: (F.trim(first(df, *n)) == "") | first(df, *n).try_cast("double").between(0, 10)
    return {"bad vulnerability id": first(df, "id", "cve_id").rlike(r"^CVE-\d{4}-\d+$"), "bad score": number("cvss31_basescore", "cvss31") & number("cvss2_basescore", "cvss2")}


def _pattern(df: DataFrame) -> dict[str, Column]:
    return {"no pattern id": first(df, "ID", "capec_id").rlike(r"\d"), "no name": F.trim(first(df, "Name")) != ""}


def _defence(df: DataFrame) -> dict[str, Column]:
    return {"no defence": tx.uri_tail(first(df, "def_tech")) != "", "bad technique id": tx.uri_tail(first(df, "off_tech_id", "off_tech")).rlike(r"^T\d{4}(\.\d{3})?$")}


def _engagement(df: DataFrame) -> dict[str, Column]:
    return {"no activity": first(df, "eav_id", "eac_id") != "", "bad technique id": first(df, "attack_id").rlike(r"^T\d{4}(\.\d{3})?$"), "bad version": (F.trim(first(df, "version")) == "") | first(df, "version").try_cast("int").isNotNull()}


#: For each CSV catalogue what its rows must hold, and what makes records of good ones.
CATALOGUES: dict[str, tuple[Callable[[DataFrame], dict[str, Column]], Callable[[DataFrame], DataFrame]]] = {
    "kev": (_kev, catalogs.kev_rows),
    "mapping": (_mapping, catalogs.mapping_rows),
    "feed": (_feed, catalogs.feed_rows),
    "patterns": (_pattern, catalogs.pattern_rows),
    "defence": (_defence, catalogs.defence_rows),
    "engagement": (_engagement, catalogs.engagement_rows),
}


def catalogue(spark: SparkSession, path: str, kind: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a CSV catalogue: those of its reader in catalogs, and REJECTED."""
    rules, records = CATALOGUES[kind]
    raw = csv_rows(spark, path, lines)
    good, rejected = parted(raw, rules(raw))
    return records(good), rejected


def stix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(objects, rejected): a bundle's objects, without those that lack a type or id; a file that is no JSON, or has no objects, is one rejected row."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"), "value", F.from_json("value", catalogs.STIX)["objects"].alias("objects"))
    whole = files.where("objects IS NULL").select(F.col("_file").alias("file"), F.col("value").alias("row"), F.array(F.lit("malformed file")).alias("reasons"))
    objects = files.where("objects IS NOT NULL").select("_file", F.explode("objects").alias("o"))
    ok = (F.coalesce("o.type", F.lit("")) != "") & (F.coalesce("o.id", F.lit("")) != "")
    lacking = objects.where(~ok).select(F.col("_file").alias("file"), F.to_json("o").alias("row"), F.array(F.lit("no type or id")).alias("reasons"))
    return catalogs.with_external(objects.where(ok).select("o.*")), whole.unionByName(lacking)


def keywords(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(technique_id, keyword, pos) of JSON objects of lists, and what is none, or has an id that is no technique's."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value", F.from_json("value", "map<string, array<string>>").alias("m"))
    whole = files.where("m IS NULL").select("file", F.col("value").alias("row"), F.array(F.lit("malformed file")).alias("reasons"))
    lists = files.where("m IS NOT NULL").select("file", F.explode("m").alias("technique_id", "ks"))
    ok = F.col("technique_id").rlike(r"^T\d{4}(\.\d{3})?$") & F.col("ks").isNotNull()
    bad = lists.where(~ok).select("file", F.to_json(F.create_map("technique_id", "ks")).alias("row"), F.array(F.when(F.col("ks").isNull(), "no list").otherwise("bad technique id")).alias("reasons"))
    return lists.where(ok).select("technique_id", F.posexplode("ks").alias("pos", "keyword")), whole.unionByName(bad)
