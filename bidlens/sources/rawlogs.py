"""Raw log files: discovery, reading and typing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlens import schema
from bidlens.functions import cleaning

# --- Fixed values: how raw files and season folders are named ---------------
FILE_NAME_PATTERN = r"^(bid|imp|clk|conv)\.(\d{8})\.txt(?:\.bz2)?$"
SEASON_FOLDERS = {"training2nd": 2, "training3rd": 3}
SAMPLE_ROWS_PER_FILE = 20_000
# ----------------------------------------------------------------------------


def _path_parts(path: Column) -> dict[str, Column]:
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.element_at(F.split(path, "/"), -2)
    day = F.regexp_extract(name, FILE_NAME_PATTERN, 2)
    season = F.coalesce(*[F.when(folder == f, F.lit(n)) for f, n in SEASON_FOLDERS.items()])
    return {
        "log_type": F.nullif(F.regexp_extract(name, FILE_NAME_PATTERN, 1), F.lit("")),
        "season": season,
        "date": F.to_date(F.nullif(day, F.lit("")), "yyyyMMdd"),
    }


def describe_paths(files: DataFrame) -> DataFrame:
    """Log type, season and day of every file; other files drop out.

    A type or day with no file simply has no row.
    """
    parts = _path_parts(F.col("path"))
    return (files.select("path", "length", *[c.alias(n) for n, c in parts.items()])
            .where(F.col("log_type").isNotNull() & F.col("season").isNotNull()))


def discover_files(spark: SparkSession, root: str, seasons: Sequence[int] = (2, 3),
                   log_types: Sequence[str] = tuple(schema.LOG_TYPES)) -> DataFrame:
    """The raw files below ``root`` (only listed, their content is not read)."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .load(root).select("path", "length"))
    return describe_paths(listed).where(
        F.col("season").isin(*seasons) & F.col("log_type").isin(*log_types))


def read_lines(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Lines of plain or bz2 files with the season and day their path names.

    The text source keeps empty fields and quotes as they are; bz2 splits, so
    one large file feeds many tasks.
    """
    lines = spark.read.text(list(paths)).withColumn("_path", F.col("_metadata.file_path"))
    parts = _path_parts(F.col("_path"))
    return lines.select(F.col("value").alias("line"), parts["season"].alias("season"),
                        parts["date"].alias("date"))


def sample_lines(spark: SparkSession, paths: Iterable[str],
                 rows: int = SAMPLE_ROWS_PER_FILE) -> DataFrame:
    """Development sample: the first ``rows`` lines of every file, all files in one scan.

    Lines of a file stand in the order of the splits' first bytes and of their place in
    the split.  Each task keeps ``rows`` lines of a file at most before they are shuffled.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    parts = _path_parts(F.col("_path"))
    order = Window.partitionBy("_path").orderBy("_start", "_at")
    return lines.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).select(
        "line", parts["season"].alias("season"), parts["date"].alias("date"))


def split_fields(lines: DataFrame, log_type: str, keep: Sequence[str] = ("season", "date")) -> DataFrame:
    """Tab-separated text to named text columns; a line of another width stops the job."""
    names = schema.raw_columns(log_type)
    fields = F.split(F.col("line"), "\t", -1)
    checked = F.when(F.size(fields) == len(names), fields).otherwise(F.raise_error(F.concat(
        F.lit(f"{log_type} line needs {len(names)} fields, has "),
        F.size(fields).cast("string"))))
    parsed = lines.select(*keep, checked.alias("_fields"))
    return parsed.select(*keep, *[F.col("_fields")[i].alias(n) for i, n in enumerate(names)])


def check_logtype(fields: DataFrame, log_type: str) -> DataFrame:
    """Every row must carry the code of its file's type."""
    code = schema.LOGTYPE_CODE.get(log_type)
    if code is None:
        return fields
    found = F.col("logtype")
    problem = F.concat(F.lit(f"logtype must be {code} in {log_type} files, found "),
                       F.coalesce(found, F.lit("nothing")))
    return fields.withColumn("logtype", F.when(found == code, found).otherwise(F.raise_error(problem)))


def type_fields(fields: DataFrame, log_type: str, keep: Sequence[str] = ("season", "date"),
                bucket=cleaning.hash_bucket) -> DataFrame:
    """Text columns to the declared layout of the log type's table."""
    target = schema.output_schema(log_type)
    text = {n: cleaning.null_markers(n) for n in schema.raw_columns(log_type)}

    def build(name: str) -> Column:
        if name == "timestamp":
            return cleaning.log_timestamp(text[name])
        if name == "usertag":
            return cleaning.tag_array(text[name])
        if name in schema.INTEGER_COLUMNS:
            return cleaning.strict_int(text[name], name)
        if name.endswith("_hash"):
            return bucket(text[name.removesuffix("_hash")])
        return text[name]

    typed = fields.select(*[build(f.name).alias(f.name) for f in target], *keep)
    for field in target:
        found = typed.schema[field.name].dataType
        if found != field.dataType:
            raise TypeError(f"{field.name}: built {found}, declared {field.dataType}")
    return typed


def parse_lines(lines: DataFrame, log_type: str, keep: Sequence[str] = ("season", "date"),
                bucket=cleaning.hash_bucket) -> DataFrame:
    """Raw lines to typed rows: split, check the log type, clean, cast, hash."""
    fields = check_logtype(split_fields(lines, log_type, keep), log_type)
    return type_fields(fields, log_type, keep, bucket)


def render_lines(table: DataFrame, log_type: str, keep: Sequence[str] = ("season", "date")) -> DataFrame:
    """Typed or text rows back to raw lines (the inverse, used for test files)."""
    types = {f.name: f.dataType.typeName() for f in table.schema}

    def as_text(name: str) -> Column:
        value = F.col(name)
        if types[name].startswith("timestamp"):
            value = F.date_format(value, "yyyyMMddHHmmssSSS")
        elif types[name] == "array":
            value = F.array_join(value.cast("array<string>"), ",")
        return F.coalesce(value.cast("string"), F.lit(schema.NULL_LITERAL))

    columns = [as_text(n) for n in schema.raw_columns(log_type)]
    return table.select(F.concat_ws("\t", *columns).alias("line"), *keep)
