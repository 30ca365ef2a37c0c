"""Raw text to typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens import schema


def null_markers(name: str, value: Column | None = None) -> Column:
    """The marker text becomes NULL everywhere, the empty string in a few columns."""
    value = F.col(name) if value is None else value
    cleaned = F.nullif(value, F.lit(schema.NULL_LITERAL))
    if name in schema.EMPTY_IS_NULL:
        cleaned = F.nullif(cleaned, F.lit(""))
    return cleaned


def must_parse(parsed: Column, source: Column, what: str) -> Column:
    """``parsed``, but text that was there and did not parse stops the job."""
    problem = F.concat(F.lit(f"cannot read {what}: "), source)
    return F.when(source.isNotNull() & parsed.isNull(), F.raise_error(problem)).otherwise(parsed)


def log_timestamp(text: Column) -> Column:
    """``yyyyMMddHHmmssSSS`` in local time, milliseconds kept."""
    dotted = F.concat(F.substring(text, 1, 14), F.lit("."), F.substring(text, 15, 3))
    parsed = F.to_timestamp_ntz(dotted, F.lit("yyyyMMddHHmmss.SSS"))
    well_formed = text.rlike("^[0-9]{17}$")
    return must_parse(F.when(well_formed, parsed), text, "timestamp")


def strict_int(text: Column, what: str) -> Column:
    return must_parse(text.try_cast("int"), text, what)


def tag_array(text: Column) -> Column:
    """Comma list to ``array<int>``; empty pieces go, NULL stays NULL."""
    pieces = F.filter(F.split(text, ","), lambda piece: piece != "")
    return F.transform(pieces, lambda piece: piece.cast("int"))


def hash_bucket(value: Column, buckets: int = schema.HASH_BUCKETS,
                seed: int = schema.HASH_SEED) -> Column:
    """Seeded bucket of a text column; NULL has no bucket."""
    return F.when(value.isNotNull(), F.pmod(F.xxhash64(F.lit(seed), value), F.lit(buckets)))


def hash_bucket_md5(value: Column, buckets: int = schema.HASH_BUCKETS,
                    seed: int = schema.HASH_SEED) -> Column:
    """The same contract on md5, for agreement with other engines."""
    text = F.concat_ws(":", F.lit(str(seed)), value)
    number = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return F.when(value.isNotNull(), F.pmod(number, F.lit(buckets)))


def unit_interval(*parts: Column) -> Column:
    """A repeatable number in [0, 1) per key, whatever the partitioning.

    52 bits of an md5, so any engine with md5 can reproduce it.
    """
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
