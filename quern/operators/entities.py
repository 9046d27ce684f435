"""Create, rename, delete and upsert rows of the control plane's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import is_blank


def upsert_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of their key; other rows stay."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def update_where(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition take the changes (a rename, a summary, feedback)."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in changes.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_with_children(parents: DataFrame, children: DataFrame, gone: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those that meet the condition, and children without theirs."""
    removed = parents.filter(F.coalesce(gone, F.lit(False))).select(key)
    return delete_where(parents, gone), children.join(removed, key, "left_anti")


def normalized_scope(table: DataFrame, tenant: str = "default", org: str = "default") -> DataFrame:
    """Missing or blank tenants and organisations back-filled."""
    def filled(name: str, value: str) -> Column:
        return F.when(is_blank(F.col(name)), F.lit(value)).otherwise(F.col(name))

    return table.withColumns({"tenant_id": filled("tenant_id", tenant), "org_id": filled("org_id", org)})


def visible_tools(tools: dict[str, str], actor: Column) -> Column:
    """The names of tools whose guard the actor passes."""
    from quern.operators.filters import guard

    return F.filter(F.array(*(F.when(guard(actor, g), F.lit(n)) for n, g in tools.items())), lambda x: x.isNotNull())
