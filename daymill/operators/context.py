"""Projections of one event: text choice, displays, stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import text as T


def select_primary_text(events: DataFrame) -> DataFrame:
    """Adds ``primary_text``, ``reference_text`` and ``used_active_display``.

    The active display's own text wins unless it is excluded; then the text of its
    entry; then all other visible displays; then the single-text layout of old logs.
    """
    shown = F.filter(
        "ocr_by_display",
        lambda d: ~F.coalesce(d["excluded"], F.lit(False)) & (T.text_of(d["ocr_text"]) != ""),
    )
    is_active = lambda d: F.coalesce(
        F.coalesce(d["display"], F.lit(0)) == F.col("active_display"), F.lit(False))
    others = F.transform(F.filter("_shown", lambda d: ~is_active(d)), lambda d: d["ocr_text"])
    entry = F.element_at(F.concat(F.array(F.lit("")), F.transform(
        F.filter("_shown", is_active), lambda d: d["ocr_text"])), -1)
    own = T.text_of(F.col("ocr_active_display_text"))
    flag = F.col("ocr_active_display_excluded")
    use_own = (own != "") & F.coalesce(~flag, F.lit(False))
    use_entry = (F.col("_entry") != "") & F.coalesce(~flag, F.lit(True))
    legacy = T.strip_ws(T.text_of(F.col("ocr_text")))
    return (
        events.withColumn("_shown", F.coalesce(shown, F.array().cast(events.schema["ocr_by_display"].dataType)))
        .withColumn("_entry", entry)
        .withColumn("_others", T.strip_ws(F.array_join(others, "\n\n")))
        .withColumn("used_active_display", use_own | use_entry)
        .withColumn("_primary", F.when(use_own, own).when(use_entry, F.col("_entry")).otherwise(F.col("_others")))
        .withColumn("_legacy", F.when(F.col("_primary") == "", legacy).otherwise(F.lit("")))
        .withColumn("primary_text", F.when(F.col("_legacy") != "", F.col("_legacy")).otherwise(F.col("_primary")))
        .withColumn("reference_text", F.when(F.col("_legacy") != "", F.lit("")).otherwise(F.col("_others")))
        .drop("_shown", "_entry", "_others", "_primary", "_legacy")
    )


def primary_source(primary: Column, reference: Column, used_active: Column, legacy: Column) -> Column:
    other = (reference != "") | (T.strip_ws(T.text_of(legacy)) != "")
    return (
        F.when((primary != "") & used_active, "active_display")
        .when((primary != "") & other, "fallback_all_displays")
        .otherwise("fallback_empty")
    )


def display_entries(events: DataFrame, *keep: str) -> DataFrame:
    """One row per display of an event: ``entry_pos, display, ocr_text, is_active_display``.

    Excluded displays stay; their text is blank already.
    """
    # texts are made before they are exploded: a filter on a column would make them twice
    clean = F.transform("ocr_by_display", lambda d: F.struct(d["display"].alias("display"), T.entity_text(d["ocr_text"]).alias("ocr_text")))
    rows = events.select(*keep, "active_display", F.posexplode(clean).alias("entry_pos", "_d"))
    disp, text = F.col("_d.display"), F.col("_d.ocr_text")
    active = F.coalesce(disp == F.col("active_display"), F.lit(False))
    return (
        rows.withColumn("display", disp).withColumn("is_active_display", active)
        .withColumn("ocr_text", text).drop("_d", "active_display")
        .filter(F.col("display").isNotNull() | (F.col("ocr_text") != ""))
    )


def excluded_stub(events: DataFrame, reason: Column) -> DataFrame:
    """Rows in the same schema with everything that could identify content removed."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    url = F.when(F.col("browser").isNotNull(), F.struct(
        F.col("browser.name").alias("name"), F.lit("").alias("url"), F.col("browser.domain").alias("domain")))
    return events.withColumns({
        "window_title": F.lit(K.REDACTED_TITLE), "browser": url, "ocr_text": F.lit(""),
        "ocr_active_display_text": F.lit(""), "ocr_active_display_excluded": F.lit(None).cast("boolean"),
        "ocr_by_display": F.array().cast(kinds["ocr_by_display"]),
        "excluded": F.lit(True), "excluded_reason": reason, "has_error": F.lit(False),
    })


def error_row(events: DataFrame) -> DataFrame:
    """Rows in the same schema for captures that failed."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    return events.withColumns({
        "ocr_text": F.lit(""), "ocr_active_display_text": F.lit(""),
        "ocr_active_display_excluded": F.lit(None).cast("boolean"),
        "ocr_by_display": F.array().cast(kinds["ocr_by_display"]),
        "excluded": F.lit(False), "excluded_reason": F.lit(None).cast("string"), "has_error": F.lit(True),
    })
