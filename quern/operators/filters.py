"""Predicates: scope, knowledge bases, metadata, thresholds, runnable tasks, guards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import is_blank

SCORE_THRESHOLD = 0.3
#: Filter keys that name columns of a record rather than its metadata.
RESERVED = {
    "documentId": "document_id",
    "knowledgeBaseId": "knowledge_base_id",
    "tenantId": "tenant_id",
    "orgId": "org_id",
}


def in_knowledge_bases(ids: Column, knowledge_base_id: Column) -> Column:
    """Any base for an empty or null list, else one of them."""
    return (F.coalesce(F.size(ids), F.lit(0)) <= 0) | F.array_contains(ids, knowledge_base_id)


def in_scope(tenant: Column, org: Column, row_tenant: Column, row_org: Column) -> Column:
    """Search scope: a non-blank tenant or organisation must be the row's."""
    return (is_blank(tenant) | (row_tenant == tenant)) & (is_blank(org) | (row_org == org))


def in_control_scope(tenant: Column, org: Column, row_tenant: Column, row_org: Column) -> Column:
    """Control-plane scope: the tenant must be the row's; the organisation too, if given."""
    return row_tenant.eqNullSafe(tenant) & (is_blank(org) | row_org.eqNullSafe(org))


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal as trimmed text, whatever the case; null only equals null."""

    def plain(x: Column) -> Column:
        return F.lower(F.trim(x.cast("string")))

    return plain(a).eqNullSafe(plain(b))


def metadata_matches(filters: Mapping[str, object], metadata: Column, columns: Mapping[str, str] = RESERVED) -> Column:
    """All filters hold: reserved keys equal their column (blank: ignored); other keys must
    be in the metadata and be loosely equal."""
    condition = F.lit(True)
    for key, wanted in filters.items():
        if key in columns:
            text = "" if wanted is None else str(wanted).strip()
            if text:
                condition &= F.coalesce(F.col(columns[key]) == text, F.lit(False))
        else:
            value = F.element_at(metadata, F.lit(key)) if metadata is not None else F.lit(None)
            shown = "true" if wanted is True else "false" if wanted is False else str(wanted)
            condition &= F.coalesce(F.map_contains_key(metadata, F.lit(key)), F.lit(False)) & loosely_equal(
                value, F.lit(shown)
            )
    return condition


def metadata_column_matches(filters: Column, metadata: Column, reserved: Mapping[str, Column]) -> Column:
    """The same for filters that are a map column, one per query row."""

    def holds(entry: Column) -> Column:
        key, wanted = entry["key"], entry["value"]
        test = F.coalesce(F.map_contains_key(metadata, key), F.lit(False)) & loosely_equal(
            F.try_element_at(metadata, key), wanted
        )
        for name, column in reserved.items():
            test = F.when(key == name, is_blank(wanted) | F.coalesce(column == F.trim(wanted), F.lit(False))).otherwise(test)
        return test

    entries = F.map_entries(filters)
    return F.coalesce(F.forall(entries, holds), F.lit(True))


def exact_metadata_matches(filters: Mapping[str, str], metadata: Column) -> Column:
    """The vector store's filter: exact equality of each metadata value."""
    condition = F.lit(True)
    for key, wanted in filters.items():
        condition &= F.coalesce(F.try_element_at(metadata, F.lit(key)) == wanted, F.lit(False))
    return condition


def comparable_vectors(records: DataFrame, vector: str, dimensions: int) -> DataFrame:
    return records.filter((F.size(vector) == dimensions) & (F.size(vector) > 0))


def above_threshold(scored: DataFrame, score: str = "score", least: float = SCORE_THRESHOLD) -> DataFrame:
    return scored.filter(F.col(score) >= least)


def runnable(status: Column, next_run_at: Column, lease_expires_at: Column, now: Column) -> Column:
    """Pending and due, or running with a lease that is over; no time counts as due."""
    due = F.coalesce(next_run_at <= now, F.lit(True))
    over = F.coalesce(lease_expires_at <= now, F.lit(True))
    return ((status == "pending") & due) | ((status == "running") & over)


def traces_matching(runs: DataFrame, text: str = "", status: str = "") -> DataFrame:
    """Runs whose trace, conversation or any node id holds the text, of the status."""
    wanted = text.strip().lower()
    condition = F.lit(True)
    if wanted:
        condition &= (
            F.contains(F.lower("trace_id"), F.lit(wanted))
            | F.coalesce(F.contains(F.lower("conversation_id"), F.lit(wanted)), F.lit(False))
            | F.exists("nodes", lambda n: F.contains(F.lower(n["node_id"]), F.lit(wanted)))
        )
    if status:
        condition &= F.col("status") == status
    return runs.filter(condition)


def sessions_matching(conversations: DataFrame, text: str) -> DataFrame:
    wanted = F.lit(text.strip().lower())
    return conversations.filter(
        F.contains(F.lower("title"), wanted) | F.contains(F.lower("conversation_id"), wanted)
    )


def guard(actor: Column, needs: str) -> Column:
    """Whether an actor (struct of user_id, role, tenant_id, org_id) passes a guard."""
    signed_in = ~is_blank(actor["user_id"])
    tests = {
        "public": F.lit(True),
        "signed-in": signed_in,
        "tenant": signed_in & ~is_blank(actor["tenant_id"]),
        "org": signed_in & ~is_blank(actor["tenant_id"]) & ~is_blank(actor["org_id"]),
        "admin": signed_in & (actor["role"] == "admin"),
    }
    return tests[needs]
