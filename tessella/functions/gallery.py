"""Catalogue predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.color import as_col


def is_locked(entitlement: str | Column, subscribed: Column, work: str | Column) -> Column:
    """Paid, not subscribed and never started; a started work stays open."""
    return (as_col(entitlement) == "paid") & ~subscribed & as_col(work).isNull()


def is_impossible(download: str | Column, work: str | Column) -> Column:
    """A work can not exist for an asset that was never downloaded."""
    return (as_col(download) == "notDownloaded") & as_col(work).isNotNull()


def matches(category: Column, title: Column, wanted: str | None, query: str) -> Column:
    """Category equal (when one is chosen) and title contains the query, ignoring case."""
    ok = F.lit(True) if wanted is None else category == F.lit(wanted)
    return ok if not query else ok & F.contains(F.lower(title), F.lower(F.lit(query)))
