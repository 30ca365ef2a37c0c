"""Log layouts, column roles and the bid-time feature allowlist.

The raw files carry no header, so the names below are the library's own; the
fourth field (the hashed user id) is called ``userid``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- Fixed values of the log format --------------------------------------
EVENT_COLUMNS = [
    "bidid", "timestamp", "logtype", "userid", "useragent", "IP", "region",
    "city", "adexchange", "domain", "url", "urlid", "slotid", "slotwidth",
    "slotheight", "slotvisibility", "slotformat", "slotprice", "creative",
    "bidprice", "payprice", "keypage", "advertiser", "usertag",
]
ABSENT_FROM_BID_LOG = {"logtype", "payprice", "keypage"}
LOG_TYPES = ["bid", "imp", "clk", "conv"]
TABLE_OF_LOG_TYPE = {
    "bid": "bids", "imp": "impressions", "clk": "clicks", "conv": "conversions",
}
LOGTYPE_CODE = {"imp": "1", "clk": "2", "conv": "3"}
NULL_LITERAL = "null"
EMPTY_IS_NULL = {"urlid", "keypage", "usertag", "domain", "url"}
INTEGER_COLUMNS = ["slotwidth", "slotheight", "slotprice", "bidprice", "payprice"]
HASHED_COLUMNS = [
    "useragent", "IP", "domain", "url", "slotid", "creative", "keypage", "userid",
]
HASH_BUCKETS = 1 << 20
HASH_SEED = 7919
PARTITION_COLUMNS = ["season", "date"]
NOT_A_FEATURE = {"bidid", "bidprice"}
PLAIN_CATEGORY_COLUMNS = [
    "region", "city", "adexchange", "slotvisibility", "slotformat", "advertiser",
    "logtype",
]
PERSON_COLUMNS = ["useragent", "IP", "userid"]
# --------------------------------------------------------------------------

BID_COLUMNS = [c for c in EVENT_COLUMNS if c not in ABSENT_FROM_BID_LOG]
SETTLEMENT_COLUMNS = ["payprice", "bidprice"]


def raw_columns(log_type: str) -> list[str]:
    """Field names of one raw line, in file order."""
    if log_type not in LOG_TYPES:
        raise ValueError(f"unknown log type {log_type!r}, expected one of {LOG_TYPES}")
    return BID_COLUMNS if log_type == "bid" else EVENT_COLUMNS


def output_schema(log_type: str) -> T.StructType:
    """Typed layout of one table, without its partition columns."""
    present = set(raw_columns(log_type))
    fields = [("bidid", T.StringType()), ("timestamp", T.TimestampNTZType())]
    if "logtype" in present:
        fields.append(("logtype", T.StringType()))
    hashed_order = ["userid", "useragent", "IP", "domain", "url", "slotid",
                    "creative", "keypage"]
    for name in hashed_order:
        if name in present:
            fields.append((name, T.StringType()))
            fields.append((f"{name}_hash", T.LongType()))
    fields.append(("urlid", T.StringType()))
    fields += [(c, T.StringType()) for c in PLAIN_CATEGORY_COLUMNS if c != "logtype"]
    fields += [(c, T.IntegerType()) for c in INTEGER_COLUMNS if c in present]
    fields.append(("usertag", T.ArrayType(T.IntegerType())))
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def column_role(name: str) -> str:
    """``feature``, ``known`` (never a feature), ``partition`` or ``unknown``."""
    if name in PARTITION_COLUMNS:
        return "partition"
    base = name.removesuffix("_hash")
    if base != name:
        if base not in HASHED_COLUMNS:
            return "unknown"
        name = base
    if name in BID_COLUMNS and name not in NOT_A_FEATURE:
        return "feature"
    return "known" if name in EVENT_COLUMNS else "unknown"


def _refuse(names: Iterable[str], why: str) -> None:
    names = sorted(names)
    if names:
        raise ValueError(f"{why}: {names}")


def feature_columns(columns: Iterable[str]) -> list[str]:
    """Columns known when the bid request arrives; an unknown name raises."""
    roles = {c: column_role(c) for c in columns}
    _refuse((c for c, r in roles.items() if r == "unknown"),
            "columns outside the declared log layout")
    return [c for c, r in roles.items() if r == "feature"]


def narrow_features(columns: Iterable[str], requested: Iterable[str] | None = None) -> list[str]:
    """The allowlist, cut down to ``requested`` but kept in its own order."""
    allowed = feature_columns(columns)
    if requested is None:
        return allowed
    wanted = list(requested)
    _refuse(set(wanted) - set(allowed), "not available as bid-time features")
    return [c for c in allowed if c in wanted]


def bid_time_view(df: DataFrame, keys: Iterable[str] = ("bidid",)) -> DataFrame:
    """What a bidder may look at: features and row keys, never a settlement price."""
    features = feature_columns(c for c in df.columns if c not in keys)
    leaked = set(SETTLEMENT_COLUMNS) & {*features, *keys}
    _refuse(leaked, "settlement columns must not reach a bidder")
    return df.select(*keys, *features)


def schema_manifest() -> dict:
    """Everything a reader of the stored tables must know, ready for JSON."""
    return {
        "columns": {t: raw_columns(t) for t in LOG_TYPES},
        "tables": TABLE_OF_LOG_TYPE,
        "logtype_code": LOGTYPE_CODE,
        "null_literal": NULL_LITERAL,
        "empty_string_is_null": sorted(EMPTY_IS_NULL),
        "roles": {c: column_role(c) for c in EVENT_COLUMNS + PARTITION_COLUMNS},
        "feature_allowlist": feature_columns(BID_COLUMNS),
        "partition_columns": PARTITION_COLUMNS,
        "hash": {"columns": HASHED_COLUMNS, "buckets": HASH_BUCKETS, "seed": HASH_SEED},
        "output": {t: [f.simpleString() for f in output_schema(t)] for t in LOG_TYPES},
    }
