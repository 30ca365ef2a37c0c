"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own order of preference over the slots of a table of prime
size: it starts at an offset and goes on by a skip, both from its name's digest.
The shards take turns; each claims its next free slot until none is left, so
shards hold the same number of slots, give or take one, and most slots keep
their shard when a shard is added or lost.  A row's slot is its key's digest
modulo the table size; the table has ``slots`` rows, never more, and is
broadcast, so placing a row takes one look-up and no shuffle.

A key that holds a large share of the rows would fill one shard.  ``spread``
names further columns that are mixed into the key where such keys exist; without
it rows of one key stay together.

``write_shards`` stores whole rows by shard, where they are read: no row moves to
another task, and a hot shard gets several files in every task.

Defined results: NULL keys are a key of their own; repeated rows go to the same
shard; empty tables give no rows and no files.  ``slot`` and ``shard`` come after
the input's columns; input columns of these names, in any case, keep their values
under a name with underscores in front.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm.tables import quoted

SLOTS = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard; a prime size makes every skip visit every slot."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill_table(names: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot."""
    if not is_prime(slots) or not 0 < len(names) <= slots or len(set(names)) < len(names):
        raise ValueError("the table needs a prime size and that many different shards at most")
    table, taken = [-1] * slots, 0
    places = [preference(n, slots) for n in names]
    heads = [offset for offset, _ in places]
    while True:
        for shard, (_, skip) in enumerate(places):
            while table[heads[shard]] >= 0:
                heads[shard] = (heads[shard] + skip) % slots
            table[heads[shard]] = shard
            taken += 1
            if taken == slots:
                return table


def slot_of(keys: Sequence[Column], slots: int = SLOTS) -> Column:
    """The first 60 bits of the key's md5, modulo the table size."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def table_frame(spark: SparkSession, names: Sequence[str], slots: int = SLOTS) -> DataFrame:
    table = fill_table(names, slots)
    return spark.createDataFrame(list(enumerate(table)), "slot long, shard int")


def free_names(columns: Sequence[str], taken: Sequence[str] = ("slot", "shard")) -> list[str]:
    """The input's column names, with underscores before those that the operator needs."""
    used, out = {c.lower() for c in [*columns, *taken]}, []
    for name in columns:
        new = name
        if name.lower() in taken:
            while new.lower() in used:
                new = f"_{new}"
            used.add(new.lower())
        out.append(new)
    return out


def assign(df: DataFrame, keys: Sequence[str], names: Sequence[str], spread: Sequence[str] = (),
           slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row."""
    slot = slot_of([F.col(quoted(c)) for c in [*keys, *spread]], slots).alias("slot")
    free = [F.col(quoted(c)).alias(new) for c, new in zip(df.columns, free_names(df.columns))]
    placed = df.select(*free, slot)
    return placed.join(F.broadcast(table_frame(df.sparkSession, names, slots)), "slot").select(
        *map(quoted, placed.columns), "shard")


def write_shards(df: DataFrame, path: str, keys: Sequence[str], names: Sequence[str],
                 spread: Sequence[str] = (), rows_per_file: int = 1_000_000) -> DataFrame:
    """One folder per shard; returns the stored rows, ``shard`` last."""
    placed = assign(df, keys, names, spread)
    (placed.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd")
     .partitionBy("shard").parquet(path))
    return df.sparkSession.read.schema(placed.schema).parquet(path)
