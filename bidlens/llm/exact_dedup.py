"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so: after at least
``SHORTEST`` characters at the next boundary, at ``LONGEST`` at the latest.  The
list of its chunk digests, in order, is the text's recipe.  Chunks are gathered
once per digest and content (map-side first, so a chunk that many documents
share travels once per task), which verifies that a digest stands for one
content.  Then only recipes are compared; texts do not move.

A digest found with two contents is no identifier.  Recipes of texts that hold
such a digest carry the chunk itself next to the digest, so the comparison stays
exact whatever the digest function does.

Defined results: NULL text counts as empty, empty texts are one group; texts of
any length work, since only chunks and recipes are handled; of equal texts the
smallest ``doc_id`` stays, NULL ids last, and of repeated rows exactly one; an
empty table gives an empty result; other columns are carried and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import null_last, packed, unpacked
from bidlens.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
SHORTEST, LONGEST = 512, 4096
CHUNK = (rf"(?s).{{{SHORTEST},{LONGEST - 1}}}?[a-z.,]\x20(?=[a-e])|.{{1,{LONGEST}}}")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def strong_digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def unverified_digests(docs: DataFrame, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that stand for more than one content; empty for any real digest function."""
    pieces = docs.select(F.explode(chunks(normalised(F.col(text)))).alias("chunk"))
    contents = pieces.select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    return materialize(contents.groupBy("digest").agg(F.count("*").alias("contents"))
                       .where("contents > 1").select("digest"), "unverified")


def with_recipes(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                 digest: Callable[[Column], Column] = strong_digest) -> DataFrame:
    """One row per document: ``doc`` (the columns of ``keep``), ``row``, ``recipe``, ``text_sha256``."""
    unverified = unverified_digests(docs, text, digest)
    whole = normalised(F.col(text))
    kept = keep or docs.columns
    doc = F.struct(*[F.col("doc").getField(c).alias(c) for c in kept]).alias("doc")
    parts = packed(docs, whole.alias("whole"), F.monotonically_increasing_id().alias("row"))
    recipe = F.transform(chunks(F.col("whole")), digest)
    plain = parts.select(doc, "row", recipe.alias("recipe"), F.sha2("whole", 256).alias("text_sha256"))
    if unverified.isEmpty():
        return materialize(plain, "recipes")
    doubtful = (parts.select("row", F.explode(F.transform(chunks(F.col("whole")), digest)).alias("digest"))
                .join(unverified, "digest", "left_semi").select("row").distinct()
                .withColumn("doubtful", F.lit(True)))
    spelled = F.transform(chunks(F.col("whole")), lambda c: F.concat(digest(c), F.encode(c, "utf-8")))
    return materialize(
        parts.join(doubtful, "row", "left").select(
            doc, "row", F.when(F.col("doubtful"), spelled).otherwise(recipe).alias("recipe"),
            F.sha2("whole", 256).alias("text_sha256")), "recipes")


def duplicate_groups(recipes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per recipe that occurs more than once: ``first`` (missing, value, tie0 = row) and ``size``."""
    groups = recipes.groupBy("recipe").agg(
        F.min(null_last(F.col(f"doc.{doc_id}"), F.col("row"))).alias("first"), F.count("*").alias("size"))
    return materialize(groups.where("size > 1"), "equal-texts")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 digest: Callable[[Column], Column] = strong_digest) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    recipes = with_recipes(docs, text, [doc_id], digest)
    joined = recipes.join(duplicate_groups(recipes, doc_id), "recipe", "left")
    alone = F.col("size").isNull()
    return joined.select(
        F.col(f"doc.{doc_id}").alias("doc_id"),
        F.when(alone, F.col(f"doc.{doc_id}")).otherwise(F.col("first.value")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("first.tie0") == F.col("row"))).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    recipes = with_recipes(docs, text)
    joined = recipes.join(duplicate_groups(recipes, doc_id), "recipe", "left")
    return unpacked(joined.where(F.col("size").isNull() | (F.col("first.tie0") == F.col("row"))))
