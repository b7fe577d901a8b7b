"""What the catalogue's modules share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.tables import load

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Registers queries and their statements."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def plan(self, sql: str | None = None) -> Callable[[Query], Query]:
        """A DataFrame query, with the statement that gives the same rows in DuckDB."""

        def keep(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return keep

    def statement(self, name: str, spark_sql: str, duck_sql: str | None = None) -> None:
        """A query that is a statement in both engines; tables stand in braces."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(spark_sql, **{t: load(spark, sf_dir, t) for t in sorted(set(re.findall(r"\{(\w+)\}", spark_sql)))})

        run.__name__ = name
        self.queries[name] = run
        self.sql[name] = re.sub(r"\{(\w+)\}", r"\1", duck_sql or spark_sql)


def unique_names_sql(rows: str, key: str, out: str, longest: int) -> str:
    """The statement of names made unique, found name by name: of the numbers from 2 on that no bare name spells, each further row of a stem takes the next.

    ``rows`` gives the key and ``raw``, the text to name by.
    """
    return f"""
    WITH s AS (SELECT {key}, coalesce(nullif(trim(left(trim(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '-'), {longest + 10})), ''), 'section') AS base FROM ({rows})),
    r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY {key}) AS n FROM s), bare AS (SELECT {key}, base FROM r WHERE n = 1),
    again AS (SELECT {key}, left(base, {longest}) AS stem, row_number() OVER (PARTITION BY left(base, {longest}) ORDER BY base, {key}) AS j FROM r WHERE n > 1),
    tops AS (SELECT stem, max(j) AS most FROM again GROUP BY stem), taken AS (SELECT regexp_extract(base, '^(.+)-([1-9][0-9]*)$', 1) AS stem, TRY_CAST(regexp_extract(base, '^(.+)-([1-9][0-9]{{0,8}})$', 2) AS BIGINT) AS k FROM bare WHERE regexp_matches(base, '^.+-[1-9][0-9]{{0,8}}$')),
    cand AS (SELECT tops.stem, unnest(range(2, most + 2 + (SELECT count(*) FROM taken t WHERE t.stem = tops.stem))) AS x FROM tops),
    free AS (SELECT stem, x, row_number() OVER (PARTITION BY stem ORDER BY x) AS j FROM cand WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.stem = cand.stem AND t.k = cand.x))
    SELECT {key}, base AS {out} FROM bare UNION ALL SELECT a.{key}, a.stem || '-' || f.x FROM again a JOIN free f ON f.stem = a.stem AND f.j = a.j"""
