"""Named queries over a folder of tables, and the SQL that gives the same rows where SQL can."""

from vitalframe.plans import general, records, rules, texts  # noqa: F401  (rules and texts register their queries with the records)

QUERIES = {**general.QUERIES, **records.QUERIES}
SQL = {**general.SQL, **records.SQL}
