"""The query catalogue. A query is a function (spark, sf_dir) -> DataFrame; most have a DuckDB statement beside them."""
