"""Event logs, artifacts and power logs: readers and writers."""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions.text import strip_ws
from daymill.functions.timefmt import offset_seconds, parse_instant, parse_local
from daymill.operators.filters import ExclusionRules
from daymill.operators.ordered import GROUP
from daymill.session import staged

DISPLAYS = "array<struct<display:int,ocr_text:string,excluded:boolean,excluded_reason:string>>"
FALSY = ["{}", "[]", '""', "null", "false", "0"]


# ---- lines ---------------------------------------------------------------------

#: Folders of appended logs; ``append`` grows with every append.
LOG_SCHEMA = "value string, source_id string, day date, append long"
#: Line counts of appended files, beside their folders.
COUNTS = "_counts"
COUNT_SCHEMA = "file string, n long, source_id string, day date, append long"
UNIT = [*GROUP, "append", "file", "block"]
LINES_PER_FILE = 100_000
_LAST = [0]


def children(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder, or None where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else None


def path_keys(file: Column) -> tuple[Column, Column]:
    """Source and day from ``…/S/D.jsonl``; the path is URL-encoded."""
    plain = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    day = F.regexp_extract(plain, r"/(\d{4}-\d{2}-\d{2})[^0-9/][^/]*$", 1)
    return F.regexp_extract(plain, r"([^/]+)/\d{4}-\d{2}-\d{2}[^/]*$", 1), day.try_cast("date")


def raw_lines(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``value, source_id, day`` and a line's place: append, file, block of the file, row.

    ``where`` may name sources and days; of appended logs only their folders are opened.  A
    missing folder has no lines.
    """
    names = children(spark, path)
    if names is None:
        lines = spark.createDataFrame([], LOG_SCHEMA + ", file string, block long")
    elif any(n.startswith("source_id=") for n in names):
        lines = spark.read.schema(LOG_SCHEMA).text(path).select("*", F.col("_metadata.file_name").alias("file"), F.lit(0).cast("long").alias("block"))
    else:
        src, day = path_keys(F.col("_metadata.file_path"))
        lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
            "value", src.alias("source_id"), day.alias("day"), F.lit(0).cast("long").alias("append"),
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if where is not None:
        lines = lines.where(where)
    return lines.select("value", *UNIT, F.monotonically_increasing_id().alias("row"))


def line_counts(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(source_id, day, append, file, block, n): the lines of every file of a log.

    Appended logs have them written beside the lines, as the last step of an append; other logs are counted, by
    blocks of their files.
    """
    names = children(spark, path) or []
    if COUNTS not in names:
        return raw_lines(spark, path, where).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))
    counts = spark.read.schema(COUNT_SCHEMA).parquet(f"{path}/{COUNTS}")
    return (counts if where is None else counts.where(where)).withColumn("block", F.lit(0).cast("long"))


def placed(rows: DataFrame, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``source_id, day, ingest_seq, value`` of raw lines: the lines before in the same file, plus those of the files before.

    A file has a bounded number of lines; only its count meets the other files.
    """
    w = Window.partitionBy(*GROUP).orderBy("append", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*UNIT, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*UNIT).orderBy("row")) - 1
    return rows.withColumn("within", within).join(before, UNIT, how).select(*GROUP, (F.col("before") + F.col("within")).alias("ingest_seq"), "value")


def read_lines(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``source_id, day, ingest_seq, value``: lines of all logs under ``path``.

    The position of a line is the number of lines before it in its source and day, in the order of
    appends, then files, then lines.  Lines of an append are there once its counts are written.
    """
    return placed(raw_lines(spark, path, where), line_counts(spark, path, where))


def parse_line(value: Column) -> Column:
    """The JSON object of a line, once more from the first ``{`` when the whole is not JSON."""
    whole = F.try_parse_json(value)
    cut = F.try_parse_json(F.substring(value, F.instr(value, "{"), F.length(value)))
    return F.coalesce(whole, F.when(F.instr(value, "{") > 1, cut))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def project_event(v: Column) -> list[Column]:
    """Event columns of a JSON object; fields of the wrong type become null."""
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    ts = get("$.ts", "string")
    error = F.to_json(F.try_variant_get(v, "$.error", "variant"))
    browser = F.when(get("$.browser.name", "string").isNotNull() | get("$.browser.domain", "string").isNotNull(), F.struct(
        get("$.browser.name", "string").alias("name"), get("$.browser.url", "string").alias("url"), get("$.browser.domain", "string").alias("domain")))
    return [
        F.coalesce(get("$.id", "string"), F.lit("")).alias("id"),
        parse_instant(ts).cast("timestamp").alias("ts"), parse_local(ts).alias("local_ts"),
        offset_seconds(ts).cast("int").alias("tz_offset_sec"), get("$.interval_sec", "int").alias("interval_sec"),
        F.coalesce(get("$.active_app", "string"), F.lit("")).alias("active_app"),
        F.coalesce(get("$.window_title", "string"), F.lit("")).alias("window_title"), browser.alias("browser"),
        get("$.active_display", "int").alias("active_display"), F.coalesce(get("$.ocr_text", "string"), F.lit("")).alias("ocr_text"),
        F.coalesce(get("$.ocr_active_display_text", "string"), F.lit("")).alias("ocr_active_display_text"),
        get("$.ocr_active_display_excluded", "boolean").alias("ocr_active_display_excluded"),
        F.coalesce(get("$.ocr_by_display", DISPLAYS), F.array().cast(DISPLAYS)).alias("ocr_by_display"),
        F.coalesce(get("$.excluded", "boolean"), F.lit(False)).alias("excluded"), get("$.excluded_reason", "string").alias("excluded_reason"),
        (error.isNotNull() & ~error.isin(FALSY)).alias("has_error"),
    ]


def parse_events(lines: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of raw lines; blank lines are neither."""
    # lines are stripped and parsed before they are exploded: a filter on a column would do it again
    some = F.filter(F.array(strip_ws(F.col("value"))), lambda v: v != "")
    rows = lines.select(*keep, F.explode(some).alias("value")).select("*", F.explode(F.array(parse_line(F.col("value")))).alias("_v"))
    ok = _is_object(F.col("_v"))
    return rows.filter(ok).select(*keep, *project_event(F.col("_v"))), rows.filter(~ok).select(*keep, "value")


def read_events(spark: SparkSession, path: str, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and bad lines of the logs under ``path``, of all sources and days or those of ``where``."""
    return parse_events(read_lines(spark, path, where), *GROUP, "ingest_seq")


def event_json(events: DataFrame) -> Column:
    """One log line of an event; null fields are left out."""
    from daymill.functions.timefmt import iso_text

    error = F.when(F.col("has_error"), F.struct(F.lit("failed").alias("message")))
    fields = [c for c in events.columns if c not in {*GROUP, "ingest_seq", "ts", "local_ts", "tz_offset_sec", "has_error"}]
    micros = F.concat(F.substring(iso_text(F.col("local_ts"), F.col("tz_offset_sec")), 1, 19), F.date_format("local_ts", ".SSSSSS"),
                      F.substring(iso_text(F.col("local_ts"), F.col("tz_offset_sec")), 20, 6))
    return F.to_json(F.struct(micros.alias("ts"), *fields, error.alias("error")))


def append_lines(lines: DataFrame, path: str, value: Column | None = None) -> None:
    """Append ``source_id, day, ingest_seq, value`` as text, in order; ``value`` may be an expression over other columns, which is
    then made once, after the rows are put in order.

    Rows are range-partitioned, so a big day spreads over files whose numbers keep the order; the
    folder of an append has a number larger than those before.  Files are gzipped: text of
    screens shrinks to a fraction.  Then the lines of the new files are counted, which
    completes the append.
    """
    spark = lines.sparkSession
    order = [*GROUP, "ingest_seq"]
    _LAST[0] = max(_LAST[0] + 1, time.time_ns() // 1000)
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select((F.col("value") if value is None else value).alias("value"), *GROUP, F.lit(_LAST[0]).alias("append"))
    rows.write.mode("append").option("maxRecordsPerFile", LINES_PER_FILE).partitionBy(*GROUP, "append").text(path, compression="gzip")
    new = spark.read.schema(LOG_SCHEMA).text(path).where(F.col("append") == _LAST[0])
    counts = new.groupBy(*GROUP, "append", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("append").partitionBy("append").parquet(f"{path}/{COUNTS}")


def append_events(events: DataFrame, path: str) -> None:
    append_lines(events, path, event_json(events))


# ---- artifacts -------------------------------------------------------------------

def read_keyed_artifact(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """Artifact text per key as a JSON object text; missing, broken or other JSON is ``{}``."""
    v = F.try_parse_json(F.col(text))
    return docs.select(*keys, F.when(_is_object(v), F.to_json(v)).otherwise("{}").alias("artifact"))


def latest_artifact(runs: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest run per key."""
    rest = [c for c in runs.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*newest))
    return runs.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def write_day_snapshot(snapshots: DataFrame, path: str, force: bool = False) -> None:
    """Write days by partition; days already complete stay as they are unless forced."""
    spark = snapshots.sparkSession
    todo = snapshots
    if not force:
        if children(spark, path) is not None:
            done = spark.read.schema(snapshots.schema).parquet(path).filter("status = 'complete'").select(*GROUP)
            todo = staged(snapshots.join(done, list(GROUP), "left_anti"), "snapshots_todo")
    todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*GROUP).parquet(path)


def write_stage(df: DataFrame, base: str, stage: int, name: str, max_stage: int | None = None) -> str | None:
    """Dump one stage as ``base/stage-NN.name``; stages past ``max_stage`` are skipped."""
    if max_stage is not None and stage > max_stage:
        return None
    path = f"{base}/stage-{stage:02d}.{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def apply_retention(df: DataFrame, today: Column, days: int, day: str = "day") -> DataFrame:
    """Keep rows younger than ``days``; as a partition filter it never opens older files."""
    return df.filter(F.datediff(today, F.col(day)) < max(1, days))


#: Names of day folders: of a partition, or of outputs with a run number.
_DAY_FOLDER = re.compile(r"(?:day=)?(\d{4}-\d{2}-\d{2})(?:-\d+)?")


def drop_old_days(spark: SparkSession, path: str, today: dt.date, days: int, dry_run: bool = False) -> list[str]:
    """Delete the day folders under ``path``, or under its ``source_id=…`` folders, that are ``days`` old or older.

    Works on names alone through Spark's file system, so nothing is read; other folders stay.  Returns the names, sorted; with
    ``dry_run`` those that would go.  A second run finds nothing.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for pattern in ("*", "source_id=*/*"):
        for x in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, pattern)) or []:
            name = _DAY_FOLDER.fullmatch(x.getPath().getName())
            if not name or not x.isDirectory():
                continue
            try:
                age = (today - dt.date.fromisoformat(name[1])).days
            except ValueError:  # no day of the calendar
                continue
            if age >= max(1, days):
                parent = x.getPath().getParent().getName()
                gone.append(f"{parent}/{x.getPath().getName()}" if "/" in pattern else x.getPath().getName())
                if not dry_run:
                    fs.delete(x.getPath(), True)
    return sorted(gone)


# ---- power log and rules -----------------------------------------------------------

def parse_power_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Power state changes of a power log; other lines fall away."""
    hit = lambda i: F.regexp_extract("value", K.POWER_LINE, i)
    iso = F.concat(F.translate(hit(1), " ", "T"), F.substring(hit(2), 1, 3), F.lit(":"), F.substring(hit(2), 4, 2))
    return lines.filter(F.col("value").rlike(K.POWER_LINE)).select(
        *keep, parse_instant(iso).cast("timestamp").alias("ts"), hit(3).alias("power_state")).filter("ts is not null")


def parse_assertion_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """``name count`` lines; the last one of a name is the caller's choice of order."""
    line = F.trim("value")
    return lines.filter(line.rlike(K.ASSERTION_LINE) & ~line.endswith(":")).select(
        *keep, F.regexp_extract(line, K.ASSERTION_LINE, 1).alias("name"), F.regexp_extract(line, K.ASSERTION_LINE, 2).cast("long").alias("n"))


def read_power_log(spark: SparkSession, path: str) -> DataFrame:
    lines = read_lines(spark, path)
    return parse_power_lines(lines, "source_id", "ingest_seq")


def rule_tables(spark: SparkSession, rules: ExclusionRules | None = None) -> DataFrame:
    """Rules as rows ``kind, pattern, rank`` in matching order."""
    r = rules or ExclusionRules()
    rows = [("app", a) for a in r.apps] + [("locked", K.LOCKED_APP)]
    rows += [("domain_kw", k) for k in r.domain_keywords] + [("text_kw", k) for k in r.text_keywords]
    return spark.createDataFrame([(k, p, i) for i, (k, p) in enumerate(rows)], "kind string, pattern string, rank int")
