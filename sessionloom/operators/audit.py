"""Content audit of a text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns of private paths, drive paths and secret tokens.
PRIVATE_PATH = r"(?i)(?:[A-Za-z]:[\\/](?:Users|home)[\\/][^\\/\s]+|/home/[^/\s]+|/Users/[^/\s]+)"
DRIVE_PATH = r"(?<![A-Za-z])[A-Za-z]:[\\/]"
TOKENS = [r"gh[opsu]_[A-Za-z0-9]{20,}", r"sk-[A-Za-z0-9_-]{20,}", r"AKIA[0-9A-Z]{16}"]


def problems(text: Column, payload: Column, max_bytes: int) -> Column:
    """Names of the problems of a row: its size, its text, its JSON payload."""
    secret = F.lit(False)
    for pattern in TOKENS:
        secret = secret | text.rlike(pattern)
    tests = {
        "large file": F.octet_length(text) > max_bytes,
        "invalid JSON": payload.isNotNull() & F.try_parse_json(payload).isNull(),
        "personal absolute path": text.rlike(PRIVATE_PATH),
        "machine-specific drive path": text.rlike(DRIVE_PATH),
        "possible secret token": secret,
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def audit(rows: DataFrame, max_bytes: int) -> DataFrame:
    """(row id, problem) for every finding. rows: doc_id, text, payload."""
    return rows.select("doc_id", F.explode_outer(problems(F.col("text"), F.col("payload"), max_bytes)).alias("problem")).where(
        F.col("problem").isNotNull()
    )
