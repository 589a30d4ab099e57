"""Data dictionary: one documentation table, rendered as Markdown rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspan.functions.expr import at, ordered_names, type_text
from fleetspan.plans.reports import union_sections

_COLUMN_FIELDS = {
    "column_name": "string", "column_id": "bigint", "type_text": "string", "is_nullable": "int", "is_primary_key": "int",
    "is_foreign_key": "int", "is_identity": "int", "default_value": "string",
}
_WHERE = ["server_name", "database_name"]
# Object types that are listed by name, and the section each has in the document.
NAMED = [(2, "VIEW"), (3, "PROCEDURE"), (4, "FUNCTION"), (5, "PACKAGE BODY"), (6, "SEQUENCE")]


def documentation(columns: DataFrame, objects: DataFrame, indexes: DataFrame, index_columns: DataFrame, as_of: datetime) -> DataFrame:
    """Tables with columns, indexes and constraints, and views, routines, packages and sequences in one table.

    An index or constraint is a row of its table: its name (its kind) in column_name, its columns in type_text.
    """
    described = columns.select(
        *_WHERE,
        F.lit("COLUMN").alias("object_type"),
        "schema_name",
        "object_name",
        "column_name",
        F.col("column_id").cast("bigint").alias("column_id"),
        type_text(F.col("data_type"), F.col("max_length"), F.col("num_precision"), F.col("num_scale")).alias("type_text"),
        *[F.col(c).cast("int").alias(c) for c in ("is_nullable", "is_primary_key", "is_foreign_key", "is_identity")],
        "default_value",
    )
    blank = {name: F.lit(None).cast(kind) for name, kind in _COLUMN_FIELDS.items()}
    tables = (
        columns.select(*_WHERE, F.lit("TABLE").alias("object_type"), "schema_name", "object_name")
        .distinct()
        .withColumns(blank)
    )
    others = objects.where(F.col("object_type").isin([kind for _, kind in NAMED])).select(
        *_WHERE, "object_type", F.col("owner").alias("schema_name"), "object_name"
    ).withColumns(blank)
    key = ["server_name", "database_name", "schema_name", "table_name", "index_id"]
    lists = index_columns.groupBy(*key).agg(F.array_join(ordered_names(F.col("key_ordinal"), F.col("column_name")), ", ").alias("type_text"))
    indexed = indexes.join(lists, key).select(
        *_WHERE, F.lit("INDEX").alias("object_type"), "schema_name", F.col("table_name").alias("object_name"), F.col("index_name").alias("column_name"),
        F.col("index_id").cast("bigint").alias("column_id"), "type_text", F.lit(None).cast("int").alias("is_nullable"), F.col("is_primary_key").cast("int"),
        F.lit(None).cast("int").alias("is_foreign_key"), F.lit(None).cast("int").alias("is_identity"),
        F.when(F.col("is_primary_key") == 1, " PRIMARY KEY").when(F.col("is_unique") == 1, " UNIQUE").otherwise("").alias("default_value"),
    )
    # The columns of one table are a bounded list.
    kinds = F.array_compact(F.array(F.when(F.col("is_primary_key") == 1, "PRIMARY KEY"), F.when(F.col("is_foreign_key") == 1, "FOREIGN KEY")))
    constrained = (
        columns.select(*_WHERE, "schema_name", "object_name", "column_id", F.col("column_name").alias("name"), F.explode(kinds).alias("column_name"))
        .groupBy(*_WHERE, "schema_name", "object_name", "column_name")
        .agg(F.array_join(ordered_names(F.col("column_id"), F.col("name")), ", ").alias("type_text"))
        .withColumns({n: F.lit(None).cast(k) for n, k in _COLUMN_FIELDS.items() if n not in ("column_name", "type_text", "column_id")})
        .withColumns({"object_type": F.lit("CONSTRAINT"), "column_id": F.when(F.col("column_name") == "PRIMARY KEY", 1).otherwise(2).cast("bigint")})
    )
    return union_sections([tables, described, others, indexed, constrained]).withColumn("capture_time", at(as_of))


def markdown(doc: DataFrame, style: str = "list") -> DataFrame:
    """Rows of a Markdown document, sortable by (server, database, section_no, object, line_no, column).

    ``list``: one bullet per column with flags. ``table``: a Markdown table per object.
    """
    name = F.concat_ws(".", "schema_name", "object_name")
    kind = F.col("object_type")
    flag = lambda hit, text: F.when(hit, text).otherwise("")
    bullet = F.concat(
        F.col("column_name"), F.lit(" ("), F.col("type_text"),
        flag(F.col("is_primary_key") == 1, " PK"),
        flag(F.col("is_foreign_key") == 1, " FK"),
        flag(F.col("is_nullable") == 0, " NOT NULL"),
        flag(F.col("is_identity") == 1, " IDENTITY"),
        F.coalesce(F.concat(F.lit(" DEFAULT "), F.col("default_value")), F.lit("")),
        F.lit(")"),
    )
    grid = F.concat(
        F.lit("| "), F.col("column_name"), F.lit(" | "), F.col("type_text"), F.lit(" | "),
        F.when(F.col("is_nullable") == 0, "NO").otherwise("YES"), F.lit(" | "), F.coalesce("default_value", F.lit("")), F.lit(" |"),
    )

    def lines(df: DataFrame, section_no: int, line_no, text) -> DataFrame:
        return df.select(
            *_WHERE,
            F.lit(section_no).cast("bigint").alias("section_no"),
            name.alias("object_name"),
            line_no.cast("bigint").alias("line_no"),
            text.alias("line"),
        )

    tables = doc.where(kind == "TABLE")
    columns = doc.where(kind == "COLUMN")
    parts = [
        lines(tables, 1, F.lit(0), F.concat(F.lit("## " if style == "list" else "### "), name)),
        lines(columns, 1, F.col("column_id") + 3, bullet if style == "list" else grid),
    ]
    if style == "table":
        parts.append(lines(tables, 1, F.lit(1), F.lit("| Column | Type | Nullable | Default |")))
        parts.append(lines(tables, 1, F.lit(2), F.lit("|--------|------|----------|---------|")))
    listed = F.concat(F.lit("- "), F.col("column_name"), F.lit(" ("), F.col("type_text"), F.lit(")"), F.coalesce("default_value", F.lit("")))
    parts.append(lines(doc.where(kind == "INDEX"), 7, F.col("column_id"), listed))
    parts.append(lines(doc.where(kind == "CONSTRAINT"), 8, F.col("column_id"), listed))
    for number, label in NAMED:
        parts.append(lines(doc.where(kind == label), number, F.lit(0), F.concat(F.lit("- "), name)))
    return union_sections(parts)


def quick_reference(doc: DataFrame) -> DataFrame:
    """Tables with their column count, then routines."""
    name = F.concat_ws(".", "schema_name", "object_name")
    tables = (
        doc.where(F.col("object_type") == "COLUMN")
        .groupBy(*_WHERE, name.alias("object_name"))
        .agg(F.count("*").alias("column_count"))
        .withColumn("object_type", F.lit("TABLE"))
    )
    routines = doc.where(F.col("object_type").isin("PROCEDURE", "FUNCTION")).select(
        *_WHERE, name.alias("object_name"), F.lit(None).cast("bigint").alias("column_count"), "object_type"
    )
    return tables.unionByName(routines)
