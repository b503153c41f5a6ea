"""Tenant access: which namespaces a caller may see, as a check and as a row filter."""

from __future__ import annotations

import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ns_key


class AccessDenied(PermissionError):
    """The caller may not see the namespace."""


def key_of(namespace: str | None) -> str:
    return (namespace or "").strip() or "default"


def require_access(namespace: str | None, allowed: set[str] | None) -> None:
    if not allowed:
        raise AccessDenied("unauthenticated")
    if "*" not in allowed and key_of(namespace) not in allowed:
        raise AccessDenied(f"namespace {key_of(namespace)!r} is not allowed")


def visible(df: DataFrame, allowed: set[str] | None) -> DataFrame:
    """Rows of the allowed namespaces; all of them under ``*``, none without a caller. The filter reaches the scan."""
    if not allowed:
        return df.where(F.lit(False))
    return df if "*" in allowed else df.where(F.col("namespace").isin(sorted(allowed)))


def parse_allowed(listed: str | list[str] | None) -> set[str]:
    parts = listed.split(",") if isinstance(listed, str) else listed or []
    return {p.strip() for p in parts if p.strip()}


def allowed_for(key: str | None, keys: dict[str, str]) -> set[str]:
    """The namespaces of an API key; every known key is compared in constant time."""
    found: set[str] = set()
    for known, listed in keys.items():
        if hmac.compare_digest(known.encode(), (key or "").encode()):
            found = parse_allowed(listed)
    return found


def normalised(df: DataFrame) -> DataFrame:
    return df.withColumn("namespace", ns_key(F.col("namespace")))
