"""Fingerprints of inputs and settings, and checks of a configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(settings: Mapping[str, Any]) -> str:
    """First ten hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()[:10]


def table_digest(df: DataFrame) -> dict[str, int | str]:
    """Rows and an order-insensitive digest of a table: the sum of its row hashes."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    return {"rows": row["n"], "digest": row["digest"]}


def differences(expected: Mapping[str, Any], found: Mapping[str, Any], prefix: str = "") -> list[str]:
    """Dotted names of the settings that differ, with both values."""
    out: list[str] = []
    for key in sorted({*expected, *found}):
        a, b = expected.get(key), found.get(key)
        if isinstance(a, Mapping) and isinstance(b, Mapping):
            out += differences(a, b, f"{prefix}{key}.")
        elif a != b:
            out.append(f"{prefix}{key}: {a!r} -> {b!r}")
    return out


def require_same(expected: Mapping[str, Any], found: Mapping[str, Any], what: str) -> None:
    changed = differences(expected, found)
    if changed:
        raise ValueError(f"{what} was made with other settings: " + "; ".join(changed))


#: Settings that must be there, with their type.
REQUIRED = {
    "city": str, "splits.train": (int, float), "splits.database": (int, float), "splits.query": (int, float), "pairs.positive_m": (int, float), "pairs.uncertain_m": (int, float),
    "pairs.hard_min_m": (int, float), "pairs.hard_max_m": (int, float), "retrieval.top_k": int, "retrieval.ks": list, "retrieval.thresholds_m": list,
}


def config_errors(config: Mapping[str, Any]) -> list[str]:
    """Every fault of a configuration, not just the first."""
    values, errors = {}, []
    for name, kind in REQUIRED.items():
        node: Any = config
        for part in name.split("."):
            node = node.get(part) if isinstance(node, Mapping) else None
        if node is None:
            errors.append(f"{name} is missing")
        elif not isinstance(node, kind) or isinstance(node, bool):
            errors.append(f"{name} has the wrong type: {node!r}")
        else:
            values[name] = node
    shares = [values.get(f"splits.{s}") for s in ("train", "database", "query")]
    if None not in shares and (min(shares) <= 0 or abs(sum(shares) - 1) > 1e-9):
        errors.append(f"splits must be positive and add up to 1, not {sum(shares):g}")
    radii = [values.get(f"pairs.{p}") for p in ("positive_m", "uncertain_m", "hard_min_m", "hard_max_m")]
    if None not in radii and not 0 < radii[0] <= radii[1] <= radii[2] < radii[3]:
        errors.append("pairs must satisfy 0 < positive_m <= uncertain_m <= hard_min_m < hard_max_m")
    ks, width = values.get("retrieval.ks"), values.get("retrieval.top_k")
    if ks is not None and (not ks or any(not isinstance(k, int) or k < 1 for k in ks)):
        errors.append("retrieval.ks must be positive whole numbers")
    elif ks and width and max(ks) > width:
        errors.append(f"Recall@{max(ks)} needs lists of that width; retrieval.top_k is {width}")
    steps = values.get("retrieval.thresholds_m")
    if steps is not None and (not steps or any(not isinstance(t, (int, float)) or t <= 0 for t in steps)):
        errors.append("retrieval.thresholds_m must be positive")
    return errors


def validate_config(config: Mapping[str, Any]) -> None:
    errors = config_errors(config)
    if errors:
        raise ValueError("the configuration is not usable:\n" + "\n".join(f"- {e}" for e in errors))
