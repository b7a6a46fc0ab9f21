"""The session store: JSON records of any age, brought to one fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import strip, to_int
from tidemark.session import materialize

# fixed values: fields of a stored record
TEXT_FIELDS = (
    "account_id", "backup_file_id", "backup_type", "full_backup_file_id", "job_id", "db_instance_id",
    "binlog_start_file", "binlog_end_file", "backupDir", "backupTime", "database", "dirName", "status", "lastError",
)
NUMBER_FIELDS = ("binlog_start_pos", "binlog_end_pos", "size", "lastExitCode")

#: pieces of a list that are summed up in one window, which holds them all at once
RUN_PIECES = 1 << 14


def read_store(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Records as text fields; anything that is not an object is left out, and only that.

    A file of the store is a JSON list, as one text that may run over lines, or one record per line.
    Left open, the first character of each file that is no blank decides. Both split among tasks.
    Numbers and true or false in number fields come as whole numbers, cut towards zero; texts stay
    as they are.
    """
    if multi_line is None:
        lists = _list_files(spark, path)
        kinds = lists.groupBy("is_list").count().collect()
        if len(kinds) == 2:
            lists = materialize(lists, "store-files")
            lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).join(lists.where("not is_list"), "file", "left_semi")
            return _records(lines.select("value").unionByName(list_elements(spark, path, lists.where("is_list").select("file"))))
        multi_line = bool(kinds) and kinds[0]["is_list"]
    return _records(list_elements(spark, path) if multi_line else spark.read.text(path))


def _list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, is_list) of every file with anything but blanks in it."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), strip(F.col("value")).alias("text"),
    )
    return lines.where("text <> ''").groupBy("file").agg((F.min_by(F.left("text", F.lit(1)), "at") == "[").alias("is_list"))


def list_elements(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """The elements of JSON lists as texts, one list for each file; a list of any size is cut by many tasks.

    Files are read in pieces that end at a comma. A comma parts elements where it stands in no string and one
    bracket deep. Both are running sums over a file's pieces: quotes make every other stretch a string, and
    brackets count outside of strings only, so a piece has two depths, for either state it may begin in. Sums run
    within runs of `RUN_PIECES` pieces, whatever the size of a split; what comes before a run is one row for each.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"),
    )
    if files is not None:
        pieces = pieces.join(files, "file", "left_semi")
    # escaped characters say nothing, nor does what is neither quote nor bracket
    bare = F.regexp_replace(F.regexp_replace("piece", r"(?s)\\.", ""), r'[^"\[\]{}]+', "")
    inner = F.split(bare, '"', -1)

    def depth(state: int) -> Column:
        outside = F.array_join(F.filter(inner, lambda _, i: i % 2 == state), "")
        return (2 * F.length(F.regexp_replace(outside, r"[\]}]", "")) - F.length(outside)).cast("long")

    run = F.expr(f"at div {RUN_PIECES}").alias("run")
    pieces = pieces.select("*", run, (F.size(inner) - 1).cast("long").alias("quotes"), depth(0).alias("deeper"), depth(1).alias("deeper_inside"))
    pieces = _running(materialize(pieces, "pieces"), "quotes", "quotes_so_far")
    inside = (F.col("quotes_so_far") - F.col("quotes")) % 2 == 1
    pieces = _running(pieces.withColumn("deeper", F.when(inside, F.col("deeper_inside")).otherwise(F.col("deeper"))), "deeper", "depth")
    ends = ((F.col("quotes_so_far") % 2 == 0) & (F.col("depth") == 1)).cast("long")
    pieces = _running(pieces.withColumn("ends", ends), "ends", "ended").withColumn("element", F.col("ended") - F.col("ends"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))), lambda p: p["piece"]), ",")
    # the list's own brackets go with its first and its last element
    text = F.when(F.col("element") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    text = F.when(F.col("depth") == 0, F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return pieces.groupBy("file", "element").agg(whole.alias("text"), F.min("depth").alias("depth")).select(text.alias("value"))


def _running(pieces: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the sum of a column up to each piece of its file: within its run, and over the runs before."""
    run = ["file", "block", "run"]
    within = Window.partitionBy(*run).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = pieces.groupBy(*run).agg(F.sum(column).alias("_n")).select(*run, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return pieces.withColumn(name, F.sum(column).over(within)).join(runs, run).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def _records(texts: DataFrame) -> DataFrame:
    """The objects among JSON texts (`value`), parsed once."""
    fields = ", ".join(f"{name} variant" for name in (*TEXT_FIELDS, *NUMBER_FIELDS))
    record = texts.select(F.from_json("value", f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r is not null and r._bad is null").select("r.*")

    def number(name: str) -> Column:
        kind, exact = F.schema_of_variant(name), F.try_variant_get(name, "$", "decimal(38,6)")
        # cut towards zero; floor gives a decimal without places
        whole = F.when(exact < 0, -F.floor(-exact)).otherwise(F.floor(exact)).cast("string")
        flag = F.try_variant_get(name, "$", "boolean").cast("int").cast("string")
        return F.when(kind == "STRING", F.try_variant_get(name, "$", "string")).when(kind == "BOOLEAN", flag).otherwise(whole).alias(name)

    return record.select(*(F.try_variant_get(f, "$", "string").alias(f) for f in TEXT_FIELDS), *map(number, NUMBER_FIELDS))


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def normalize_sessions(records: DataFrame, default_account: str = "") -> DataFrame:
    """Trimmed texts, whole numbers (0 where unreadable), `full` as the default type, and
    missing owners and ids filled in. An id is a digest of the record, so that reading
    twice gives the same id. The state of a run is kept, and failed runs stay visible."""
    texts = {f: _text(f) for f in TEXT_FIELDS}
    texts["backup_type"] = F.coalesce(F.nullif(F.lower(_text("backup_type")), F.lit("")), F.lit("full"))
    texts["account_id"] = F.coalesce(F.nullif(_text("account_id"), F.lit("")), F.lit(default_account))
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(f), F.lit("")) for f in (*TEXT_FIELDS, *NUMBER_FIELDS))))
    texts["backup_file_id"] = F.coalesce(F.nullif(_text("backup_file_id"), F.lit("")), digest)
    numbers = {f: to_int(F.col(f)) for f in NUMBER_FIELDS}
    numbers["lastExitCode"] = F.col("lastExitCode").try_cast("int")
    log_no = {f"{end}_no": F.regexp_extract(f"binlog_{end}_file", r"([0-9]+)\s*$", 1).try_cast("int") for end in ("start", "end")}
    rows = records.select(*(v.alias(k) for k, v in (texts | numbers).items()), *(v.alias(k) for k, v in log_no.items()))
    return rows.withColumn("backup_time", F.try_to_timestamp("backupTime").cast("timestamp_ntz"))
