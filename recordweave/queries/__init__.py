"""The registered queries (``CORE_QUERIES``) and their SQL for an independent engine (``CORE_SQL``)."""

from recordweave.queries import catalogue, engine_queries, records, training  # noqa: F401 - these add to the catalogue

CORE_QUERIES = {**catalogue.QUERIES, **training.QUERIES}
CORE_SQL = {**catalogue.ORACLE_SQL, **training.ORACLE_SQL}
