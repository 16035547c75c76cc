"""Content hashes over key-sorted JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def prefixed(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def sorted_json(columns: dict[str, Column]) -> Column:
    """JSON object text with keys in code-point order; nulls are left out."""
    return F.to_json(F.struct(*[columns[name].alias(name) for name in sorted(columns)]))


def stable_hash(columns: dict[str, Column]) -> Column:
    return prefixed(sorted_json(columns))


def stable_id(prefix: str, columns: dict[str, Column], length: int = 24) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(sorted_json(columns), 256), 1, length))


def canonical_json(text: Column) -> Column:
    """Free JSON text rewritten with sorted keys and no spaces."""
    return F.to_json(F.parse_json(text))
