"""Dump sessions on disk: file listings, metadata files, and what file names tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import strip

# fixed values: where a session's metadata may lie, best first; a restore takes only
# the finished ones
METADATA_FILES = ("data/metadata", "data/metadata.partial", "metadata", "metadata.partial")
FINISHED_METADATA_FILES = ("data/metadata", "metadata")

# fixed values: names of dump files
DATA_FILE = r"^([^.]+)\.([^./]+)\.([0-9]+)\.sql\.zst$"
SCHEMA_FILE = r"^([^.]+)\.(.+)-schema\.sql\.zst$"
DUMP_SUFFIX, SCHEMA_SUFFIX, DATABASE_SUFFIX = ".sql.zst", "-schema.sql.zst", "-schema-create.sql.zst"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """`path`, `size_bytes`, `modified` of all files below `root`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def session_sizes(files: DataFrame, session: str) -> DataFrame:
    return files.groupBy(session).agg(F.sum("size_bytes").alias("size_bytes"))


def pick_layout(files: DataFrame, session: str, path: str, candidates=METADATA_FILES) -> DataFrame:
    """The best metadata file of each session; sessions without one are left out."""
    rank = F.array_position(F.array(*(F.lit(c) for c in candidates)), F.col(path))
    best = files.filter(F.col(path).isin(*candidates)).groupBy(session).agg(F.min(F.struct(rank.alias("rank"), path)).alias("_best"))
    return best.select(session, F.col(f"_best.{path}").alias("metadata_file"))


def read_sections(spark: SparkSession, path: str, **options) -> DataFrame:
    """Metadata files, one row per section: `file`, `at` (its place in the file), `header`, `body`.

    The reader splits records at a `[` that begins a line, so a section arrives as one
    row and no window has to carry headers down; a huge file is still split among tasks.
    Text before the first section has a header like no other and is ignored downstream.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")
    records = spark.read.options(lineSep="\n[", **options).text(path).select("value", F.col("_metadata.file_path").alias("file"), at)
    # only the first record of a file still has its bracket
    text = F.regexp_replace("value", r"^\[", "")
    lines = records.select("file", "at", text.alias("text"), F.regexp_extract(text, r"^([^\r\n]*)", 1).alias("_first"))
    return lines.select("file", "at", F.rtrim("_first").alias("header"), F.expr("substring(text, length(_first) + 1)").alias("body"))


def _setting(body: Column, key: str) -> Column:
    """The last `key = value` of a section; comment lines do not count."""
    lines = F.transform(F.split(body, r"\r?\n"), strip)

    def wanted(line: Column) -> Column:
        return ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("=")) & (strip(F.substring_index(line, "=", 1)) == key)

    line = F.try_element_at(F.filter(lines, wanted), F.lit(-1))
    return strip(F.regexp_replace(line, r"^[^=]*=", ""))


# fixed value: header of a table's section, without its opening bracket
TABLE_HEADER = r"^`([^`]+)`\.`([^`]+)`\]$"


def metadata_objects(sections: DataFrame) -> DataFrame:
    """Tables and views a metadata file lists; unreadable row counts are 0."""
    tables = sections.filter(F.col("header").rlike(TABLE_HEADER))
    schema, name = (F.regexp_extract("header", TABLE_HEADER, i) for i in (1, 2))
    real_name = F.coalesce(F.nullif(_setting(F.col("body"), "real_table_name"), F.lit("")), name)
    rows = F.coalesce(_setting(F.col("body"), "rows").try_cast("long"), F.lit(0).cast("long"))
    is_view = F.coalesce(_setting(F.col("body"), "is_view") == "1", F.lit(False))
    carried = [c for c in sections.columns if c not in ("header", "body", "at")]
    return tables.select(
        *carried, schema.alias("schema"), name.alias("name"), real_name.alias("real_table_name"), rows.alias("rows"),
        F.when(is_view, "view").otherwise("table").alias("kind"),
    )


def source_positions(sections: DataFrame) -> DataFrame:
    """The log position of each metadata file: `log_file`, `log_pos`, or `error`.

    The lines may be commented out, in any case, the name in quotes or not; the last one
    of a section counts. Both values are needed; of several sections with both the last counts.
    """
    def last(key: str, value: str) -> Column:
        found = F.regexp_extract_all("body", F.lit(rf"(?im)^[ \t]*#?[ \t]*{key}[ \t]*=[ \t]*{value}[ \t]*\r?$"), F.lit(1))
        return F.when(F.lower("header") == "source]", F.try_element_at(found, F.lit(-1)))

    found = sections.select(
        "file", "at", strip(last("source_log_file", r'"?([^"\r\n]+)"?')).alias("f"), last("source_log_pos", "([0-9]+)").try_cast("long").alias("p")
    )
    pair = F.when((F.col("f") != "") & (F.col("p") > 0), F.struct("f", "p"))
    per_file = found.groupBy("file").agg(F.max(F.when(pair.isNotNull(), F.struct("at", pair.alias("pair")))).alias("x"))
    per_file = per_file.select("file", F.col("x.pair.f").alias("f"), F.col("x.pair.p").alias("p"))
    ok = (F.col("f") != "") & (F.col("p") > 0)
    return per_file.select(
        "file", F.when(ok, F.col("f")).alias("log_file"), F.when(ok, F.col("p")).alias("log_pos"),
        F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise("no_source_position").alias("error"),
    )


def infer_objects(files: DataFrame, session: str, file_name: str) -> DataFrame:
    """Tables known from file names alone, each once per session; order is a sort away."""
    name = F.col(file_name)
    dumps = files.filter(
        F.endswith(name, F.lit(DUMP_SUFFIX)) & ~F.endswith(name, F.lit(DATABASE_SUFFIX)) & ~F.startswith(name, F.lit("metadata"))
    )

    def part(group: int) -> Column:
        return F.when(name.rlike(DATA_FILE), F.regexp_extract(name, DATA_FILE, group)).when(
            name.rlike(SCHEMA_FILE), F.regexp_extract(name, SCHEMA_FILE, group)
        )

    found = dumps.select(session, part(1).alias("schema"), part(2).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return found.select(
        session, "schema", "name", F.col("name").alias("real_table_name"), F.lit(0).cast("long").alias("rows"), F.lit("table").alias("kind")
    )


def objects_or_inferred(objects: DataFrame, files: DataFrame, session: str, file_name: str) -> DataFrame:
    """Objects from metadata; for sessions where it gives none, from file names."""
    known = objects.select(session).distinct()
    rest = infer_objects(files.join(known, session, "left_anti"), session, file_name)
    columns = rest.columns
    return objects.select(*columns, F.lit("metadata").alias("items_source")).unionByName(
        rest.withColumn("items_source", F.lit("filenames"))
    )


def discover_tables(files: DataFrame, file_name: str, database: str) -> DataFrame:
    """Table names of one database, from schema files and data files, each once."""
    name = F.col(file_name)
    rest = F.substring(name, F.lit(len(database) + 2), F.length(name))
    table = F.when(F.endswith(rest, F.lit(SCHEMA_SUFFIX)), F.regexp_replace(rest, r"-schema\.sql\.zst$", "")).otherwise(
        F.regexp_replace(rest, r"\.[0-9]+\.sql\.zst$", "")
    )
    mine = files.filter(F.startswith(name, F.lit(f"{database}.")) & F.endswith(name, F.lit(DUMP_SUFFIX)))
    return mine.select(table.alias("name")).filter(F.col("name") != "").distinct()
