"""All registered queries of the engine's own operators, with their SQL."""

from cairnwatch.plans import catalogs, records, relational, scoring, upkeep

QUERIES = {**scoring.QUERIES, **relational.QUERIES, **records.QUERIES, **upkeep.QUERIES, **catalogs.QUERIES}
ORACLE_SQL = {**scoring.ORACLE_SQL, **relational.ORACLE_SQL, **records.ORACLE_SQL, **upkeep.ORACLE_SQL, **catalogs.ORACLE_SQL}
