"""Categorical values as text tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.schema import HASHED_COLUMNS, PLAIN_CATEGORY_COLUMNS

# --- Fixed values -----------------------------------------------------------
NULL_TOKEN = "__null__"
RARE_TOKEN = "__rare__"
NUMERIC_FIELDS = ["slotwidth", "slotheight", "slotprice"]
PLACEMENT_FIELDS = ["domain", "slotid", "creative"]
UNIT_SEPARATOR = "\u001f"
# ----------------------------------------------------------------------------
NOT_A_TOKEN = {"logtype", "keypage"}  # never in the bid log
HIGH_CARDINALITY_FIELDS = [c for c in HASHED_COLUMNS if c not in NOT_A_TOKEN]
CATEGORICAL_FIELDS = [c for c in PLAIN_CATEGORY_COLUMNS if c not in NOT_A_TOKEN] + HIGH_CARDINALITY_FIELDS


def or_null_token(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NULL_TOKEN))


def field_token(name: str) -> Column:
    return F.concat(F.lit(f"{name}="), or_null_token(F.col(name)))


def hour_token(timestamp: Column) -> Column:
    return F.concat(F.lit("hour="), F.hour(timestamp).cast("string"))


def tag_tokens(tags: Column) -> Column:
    """One token per different tag; no tags, no tokens."""
    distinct = F.array_distinct(F.coalesce(tags, F.array().cast("array<int>")))
    return F.transform(distinct, lambda tag: F.concat(F.lit("usertag="), tag.cast("string")))


def feature_tokens(fields: Sequence[str] | None = None, timestamp: str = "timestamp",
                   tags: str = "usertag") -> Column:
    """All tokens of a row: the chosen fields, the hour and the tags."""
    fields = CATEGORICAL_FIELDS if fields is None else list(fields)
    single = F.array(*[field_token(f) for f in fields], hour_token(F.col(timestamp)))
    return F.concat(single, tag_tokens(F.col(tags)))


def composite_key(*names: str) -> Column:
    """Several fields as one text key; NULL parts keep a token of their own."""
    return F.concat_ws(UNIT_SEPARATOR, *[or_null_token(F.col(n)) for n in names])
