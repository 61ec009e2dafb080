"""A taxonomy, its maps and a knowledge graph made from the tables, so that they grow with them; Spark and SQL read the same texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _technique(x: str) -> str:
    """A technique's id of a number: every third is a technique, the next two are its sub-techniques."""
    return f"('T' || (1000 + CAST(floor(({x}) / 3) AS BIGINT)) || CASE WHEN ({x}) % 3 = 0 THEN '' ELSE '.00' || (({x}) % 3) END)"


_HALF = "CAST(floor(p_partkey / 2) AS BIGINT)"
_KINDS = "CASE p_partkey % 4 WHEN 0 THEN 'RELATED_TO' WHEN 1 THEN 'SIMILAR_TO' WHEN 2 THEN 'MAPPED_TO' ELSE 'USES' END"
_NAME = "'a' || CAST(floor(p_partkey / 7) AS BIGINT) || '{0} b' || CAST(floor(p_partkey / 11) AS BIGINT)"

#: SELECT texts over the tables, whose names stand in braces.
TABLES = {
    "technique": f"SELECT {_technique('p_partkey')} AS technique_id, {_NAME.format(' of')} || ' / ' || p_name || ': ' || p_brand AS name, p_name || ' with the ' || p_type || '. Of size ' || p_size || '.' AS description, p_type AS platforms FROM {{part}}",
    "technique_keyword": f"SELECT {_technique('p_partkey')} AS technique_id, lower(p_name) AS keyword FROM {{part}} UNION ALL SELECT {_technique('p_partkey')}, lower(p_brand) FROM {{part}}",
    "technique_tactic": f"SELECT DISTINCT {_technique('l_partkey')} AS technique_id, CASE l_returnflag WHEN 'A' THEN 'Execution' WHEN 'R' THEN 'Persistence' ELSE 'Impact' END AS tactic, CASE l_returnflag WHEN 'A' THEN 'execution' WHEN 'R' THEN 'persistence' ELSE 'initial-access' END AS shortname FROM {{lineitem}} WHERE l_linenumber < 3",
    "cve_technique": f"SELECT DISTINCT 'CVE-2020-' || (1000 + l_suppkey) AS cve_id, {_technique('l_partkey % 600')} AS technique_id, CAST(5 + l_suppkey % 5 AS DOUBLE) / 10 AS confidence FROM {{lineitem}}",
    "cve_cwe": "SELECT 'CVE-2020-' || (1000 + s_suppkey) AS cve_id, 'CWE-' || (s_suppkey % 40) AS cwe_id FROM {supplier} UNION ALL SELECT 'CVE-2020-' || (1000 + s_suppkey), 'CWE-' || (40 + s_nationkey) FROM {supplier}",
    "cwe_technique": f"SELECT DISTINCT 'CWE-' || (p_partkey % 40) AS cwe_id, {_technique('p_partkey % 300')} AS technique_id FROM {{part}}",
    "cwe_rule": "SELECT DISTINCT lower(p_type) AS word_a, lower(p_name) AS word_b, 'CWE-' || (200 + length(p_name)) AS cwe_id FROM {part}",
    "capec": f"SELECT 'CAPEC-' || (100 + p_partkey) AS capec_id, {_NAME.format('')} || ' pattern' AS name FROM {{part}}",
    "edge": (
        f"SELECT {_technique('p_partkey')} AS src, {_KINDS} AS type, {_technique(_HALF)} AS dst FROM {{part}} WHERE p_partkey > 0 "
        f"UNION ALL SELECT {_technique('p_partkey')}, CASE WHEN p_partkey % 5 < 2 THEN 'SIMILAR_TO' ELSE 'RELATED_TO' END, {_technique('p_partkey + 7')} FROM {{part}} "
        f"UNION ALL SELECT 'CAPEC-' || (100 + p_partkey), CASE p_partkey % 3 WHEN 0 THEN 'MAPPED_TO' WHEN 1 THEN 'SIMILAR_TO' ELSE 'CHILD_OF' END, {_technique('p_partkey * 2')} FROM {{part}} "
        f"UNION ALL SELECT 'S' || (1000 + s_suppkey), 'USES', {_technique('s_suppkey * 5')} FROM {{supplier}} UNION ALL SELECT {_technique('s_suppkey')}, 'MITIGATED_BY', 'M' || (1000 + s_nationkey) FROM {{supplier}}"
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str, repeats: bool = False) -> DataFrame:
    """Such a table. repeats: rows as they come, for callers that deal them out before they make them distinct."""
    sources = set(re.findall(r"\{(\w+)\}", TABLES[name]))
    text = TABLES[name].replace("SELECT DISTINCT", "SELECT") if repeats else TABLES[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sources})


def derived_sql(*names: str) -> str:
    """Common table expressions of such tables, for SQL."""
    return ",\n".join(f"{n} AS MATERIALIZED ({re.sub(r'[{}]', '', TABLES[n])})" for n in names)
