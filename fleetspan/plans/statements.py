"""Generated maintenance statements: one text per row, never executed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statement texts per platform; %s takes the named columns in order.
TEMPLATES = {
    "analyze": ("ANALYZE VERBOSE %s.%s;", ["schema_name", "table_name"]),
    "analyze_table": ("ANALYZE TABLE %s.%s;", ["schema_name", "table_name"]),
    "gather_stats": ("BEGIN DBMS_STATS.GATHER_TABLE_STATS('%s', '%s'); END;", ["schema_name", "table_name"]),
    "update_statistics": ("UPDATE STATISTICS %s.%s WITH FULLSCAN;", ["schema_name", "table_name"]),
    "drop_duplicate": ("USE [%s]; DROP INDEX [%s] ON [%s].[%s];", ["database_name", "index2_name", "schema_name", "table_name"]),
    "drop_unused": ("USE [%s]; DROP INDEX [%s] ON [%s].[%s];", ["database_name", "index_name", "schema_name", "table_name"]),
    "create_index": ("CREATE INDEX [%s] ON [%s].[%s] (%s);", ["index_name", "schema_name", "table_name", "index_columns"]),
}


def maintenance_statements(df: DataFrame, template: str, min_rows: int | None = None) -> DataFrame:
    """The rows' names put into the template, largest tables kept when a row floor is given."""
    text, columns = TEMPLATES[template]
    kept = df if min_rows is None else df.where(F.col("n_live") > min_rows)
    where = [c for c in ("server_name",) if c in df.columns]  # the server to run it on
    return kept.select(*where, *columns, F.format_string(text, *columns).alias("statement"))
