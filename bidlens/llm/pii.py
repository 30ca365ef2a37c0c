"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

The base finds emails, ip addresses, cards and phone numbers by their form.  They
are the seeds of a search for identifiers that the forms miss.  An occurrence is a
whole base span, or a token that holds a digit or an at sign and meets no base
span.  It has two lexical patterns: the two words before it, and the words before
and after it.  Patterns and values make a graph.  In each round Spark scores every
pattern by the share of its different values that are believed to be of one kind,
and accepts it for that kind when the share and the number of such values are
high; then it scores every value by the accepted patterns it occurs in, and
believes those with a high score that could be of the kind at all.  After the last
round every token of a newly believed value is a span.  Base spans always stay.

Edges are distinct pairs of pattern and value, gathered map-side first, so a very
common word or identifier does not multiply; nothing is gathered per pattern.
Tables between the rounds are stored, so Spark can split skewed joins.

Positions are code points, the end exclusive.  The patterns are written so that
Java neither recurses nor starts again inside a run it has already refused.
Matches leave their text as rows with the length of the gap before them, and
places are running sums per text, so a text takes time in proportion to its length
and (but for a sort) to its matches.  Context words are taken whole, however long;
a pattern of more than 80 code points is known by its digest.

Defined results: NULL text counts as empty and has no spans; texts of any length
are read whole; repeated rows get the same spans each; ids may be NULL or
repeated, since rows have numbers of their own; an empty table gives no rows;
``mask`` carries all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.tables import packed
from bidlens.session import materialize

KINDS = ("email", "ip", "card", "phone")
# A match of an email begins where the last one ended or where a run of local characters begins.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_@%+./:-])[A-Za-z_%+./:-]*+[0-9@][A-Za-z0-9_@%+./:-]*+"

ROUNDS = 3
LEAST_VALUES, LEAST_SHARE, LEAST_SCORE = 5, 0.9, 0.9
TOKENS = len(KINDS)  # the number that stands for tokens where base forms have theirs
PIECE = 1_000  # code points of a piece, when parts of a long text are looked up
SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"


def context(gap: Column, following: Column) -> tuple[Column, Column]:
    """The patterns of an occurrence, NULL where words are missing: words before it, and words around it."""
    before = F.lower(F.regexp_extract(gap, r"(?<!\S)(\S++\s++\S++)\s*+$", 1))
    last = F.lower(F.regexp_extract(gap, r"(?<!\S)(\S++)\s*+$", 1))
    after = F.lower(F.regexp_extract(following, r"^[.:/-]*+\s*+(\S++)", 1))

    def short(pattern: Column) -> Column:
        return F.when(F.length(pattern) <= 80, pattern).otherwise(F.sha2(pattern, 256))

    return (F.when(before != "", short(F.concat(F.lit("before "), F.regexp_replace(before, r"\s+", " ")))),
            F.when((last != "") & (after != ""), short(F.concat(F.lit("around "), last, F.lit(" _ "), after))))


def matches(text: Column, kind: int, pattern: str, possible: Column) -> Column:
    """(kind, gap, size, value, before, around) of all matches from left to right; nothing is searched unless ``possible``.

    ``gap`` is the number of code points between the end of the match before and this one.
    """
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(value: Column, around: Column) -> Column:
        gap, following = around["gap"], around["next"]
        before, both = context(gap, following)
        return F.when(value.isNotNull(), F.struct(
            F.lit(kind).alias("kind"), F.length(gap).cast("bigint").alias("gap"), F.length(value).cast("bigint").alias("size"),
            value.alias("value"), before.alias("before"), both.alias("around")))

    found = F.zip_with(values, F.arrays_zip(gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("next")), one)
    return F.when(possible, F.filter(found, lambda m: m.isNotNull()))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base form counts."""
    number = digits(value)
    parts = F.forall(F.split(value, r"\."), lambda p: F.coalesce(
        F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    luhn = F.when(F.length(number).between(16, 19), passes_luhn(number)).otherwise(False)
    return F.when(kind == 1, parts).when(kind == 2, luhn).when(kind == 3, F.length(number).between(8, 15)).otherwise(True)


def matched(text: Column) -> Column:
    """The matches of all base forms and of tokens."""
    found = [matches(text, 0, EMAIL, F.contains(text, F.lit("@"))),
             matches(text, 1, IP, text.rlike(r"[0-9]\.[0-9]")),
             matches(text, 2, CARD, text.rlike(r"[0-9][\x20-]?[0-9]")),
             matches(text, 3, PHONE, F.contains(text, F.lit("+"))),
             matches(text, TOKENS, TOKEN, text.rlike("[0-9@]"))]
    none = F.slice(matches(F.lit(""), 0, EMAIL, F.lit(True)), 1, 0)
    return F.concat(*[F.coalesce(m, none) for m in found])


def occurrences(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, before, around): base spans, and tokens that meet none; from (row, matched).

    One exchange by text serves both windows.
    """
    each = found.select("row", F.posexplode("matched").alias("number", "m")).select("row", "number", "m.*").repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.sum(F.col("gap") + F.col("size")).over(so_far)
    is_token = F.col("kind") == TOKENS
    # A token ends before the points and slashes that close it.
    value = F.when(is_token, F.regexp_replace("value", "(?<![.:/-])[.:/-]++$", "")).otherwise(F.col("value"))
    placed = each.withColumn("start", ended - F.col("size")).withColumn("value", value).select(
        "row", "kind", "start", (F.col("start") + F.length("value")).alias("end"), F.lower("value").alias("value"),
        "before", "around").where(is_token | valid(F.col("kind"), F.col("value")))
    # Of base spans that start before a token's end, does any reach over its start?
    at = F.when(is_token, F.col("end") - 1).otherwise(F.col("start"))
    by_place = Window.partitionBy("row").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(~is_token, F.col("end"))).over(by_place)
    return placed.withColumn("at", at).withColumn("reach", reach).where(
        ~is_token | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("at", "reach")


def could_be(kind: Column, value: Column) -> Column:
    """Whether a value has anything of its kind's form at all."""
    count = F.length(digits(value))
    return (F.when(kind == 0, F.contains(value, F.lit("@")))
            .when(kind == 1, value.rlike(r"^[0-9a-f]{0,4}([.:][0-9a-f]{0,4}){2,7}$"))
            .when(kind == 2, count.between(12, 19)).otherwise(count.between(7, 15)))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, least_values: int = LEAST_VALUES) -> DataFrame:
    """(value, kind) that patterns discover, from edges (pattern, value, seed)."""
    sizes = materialize(edges.groupBy("pattern").agg(F.count("*").alias("values")), "pattern-sizes")
    seeds = materialize(edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind")).distinct(), "seeds")
    seed_values = seeds.select("value").distinct()
    believed, found = seeds, None
    for _ in range(rounds):
        hits = (edges.select("pattern", "value").join(believed, "value")
                .groupBy("pattern", "kind").agg(F.count("*").alias("hits")))
        accepted = materialize(
            hits.where(F.col("hits") >= least_values).join(sizes, "pattern")
            .withColumn("share", F.col("hits") / F.col("values")).where(F.col("share") >= LEAST_SHARE)
            .select("pattern", "kind", "share"), "patterns")
        doubt = F.sum(F.log(F.greatest(1.0 - F.col("share"), F.lit(1e-3))))
        found = materialize(
            edges.where("seed IS NULL").select("pattern", "value").join(accepted, "pattern")
            .groupBy("value", "kind").agg((1.0 - F.exp(doubt)).alias("score"))
            .where((F.col("score") >= LEAST_SCORE) & could_be(F.col("kind"), F.col("value")))
            .join(seed_values, "value", "left_anti").select("value", "kind"), "found-values")
        believed = seeds.unionByName(found)
    return found.groupBy("value").agg(F.min("kind").alias("kind"))


def located(docs: DataFrame, text: str, keep: list[str], least_values: int) -> tuple[DataFrame, DataFrame]:
    """Stored (doc, row) of every document, and (row, kind, start, end, base) of every span."""
    parts = packed(docs, F.coalesce(F.col(text), F.lit("")).alias("whole"))
    doc = F.struct(*[F.col("doc").getField(c).alias(c) for c in keep]).alias("doc")
    found = materialize(parts.select(
        doc, F.monotonically_increasing_id().alias("row"), matched(F.col("whole")).alias("matched")), "personal-data")
    all_found = materialize(occurrences(found), "occurrences")
    is_base = F.col("kind") < TOKENS
    edges = materialize(
        all_found.select(F.explode(F.array("before", "around")).alias("pattern"), "value", F.when(is_base, F.col("kind")).alias("seed"))
        .where("pattern IS NOT NULL AND value <> ''").groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    new = materialize(bootstrap(edges, least_values=least_values), "discovered")
    added = (all_found.where(~is_base).select("row", "start", "end", "value").join(new, "value")
             .select("row", "kind", "start", "end", F.lit(False).alias("base")))
    spans = all_found.where(is_base).select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added)
    return found.select("doc", "row"), materialize(spans, "spans")


def find_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
               least_values: int = LEAST_VALUES) -> DataFrame:
    """One row per document: ``doc`` (the columns of ``keep``), ``base`` and ``spans``, arrays of (kind, start, end)."""
    found, spans = located(docs, text, docs.columns if keep is None else keep, least_values)
    span = F.struct("kind", "start", "end")
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
                                      F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.expr(f"cast(array() as {SPANS})")
    return found.join(listed, "row", "left").select(
        "doc", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_spans(docs, text, [doc_id])

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select(F.col(f"doc.{doc_id}").alias("doc_id"), *counts,
                        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text cut into pieces; none if the range is empty."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    inside = (start % PIECE).cast("int") + 1
    one = F.substring(F.get(pieces, first), inside, (end - start).cast("int"))
    more = F.concat(F.substring(F.get(pieces, first), inside, F.lit(PIECE)),
                    F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                    F.substring(F.get(pieces, last), F.lit(1), (end - last * F.lit(PIECE).cast("bigint")).cast("int")))
    return F.when(end <= start, F.lit("")).when(first == last, one).otherwise(more)


def masked(text: Column, cuts: Column, reach: Column) -> Column:
    """The text with its cuts, (start, at, kind) in order, replaced by their kinds.

    ``at`` is the end of what was cut before and ``reach`` the end of the last cut.
    """
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def put_together(pieces: Column) -> Column:
        parts = F.transform(cuts, lambda c: F.concat(part(pieces, c["at"], c["start"]), F.get(name, c["kind"])))
        return F.concat(F.array_join(parts, ""), part(pieces, reach, F.length(text).cast("bigint")))

    return bound(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), put_together)


def cuts_of(spans: DataFrame) -> DataFrame:
    """(row, cuts, reach) for ``masked``; spans that overlap are one cut, named by the first."""
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    apart = spans.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0).cast("bigint")))
    return apart.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("at"), F.struct("start", "at", "kind")))).alias("cuts"),
        F.max("end").alias("reach"))


def mask(docs: DataFrame, text: str = "text", length: str | None = "n_chars",
         least_values: int = LEAST_VALUES) -> DataFrame:
    """``docs`` with personal data masked; a column with the text's length follows it."""
    found, spans = located(docs, text, docs.columns, least_values)
    own = F.col("doc").getField(text)
    done = found.join(cuts_of(spans), "row", "left").select(
        "doc", F.when(F.col("cuts").isNotNull(), masked(own, F.col("cuts"), F.col("reach"))).alias("masked"))
    columns = []
    for field in docs.schema:
        value = F.col("doc").getField(field.name)
        if field.name == text:
            value = F.coalesce("masked", value)
        elif field.name == length:
            value = F.coalesce(F.length("masked").cast(field.dataType), value)
        columns.append(value.alias(field.name))
    return done.select(F.struct(*columns).alias("doc")).select("doc.*")
