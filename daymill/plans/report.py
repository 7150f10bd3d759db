"""Report tables: ordered lines, one document per key, and typed blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import text as T
from daymill.functions.timefmt import cost_text, duration_text, week_end, weekday_name
from daymill.operators import weekly as W
from daymill.operators.ordered import GROUP
from daymill.operators.usage import usage_text

# ---- fixed values: report headings ------------------------------------------
WEEK_HEAD, DAY_HEAD, DAY_PLAIN = "# 週次レポート ", "# ", "# 作業ログ "
FOLD = ["<details>", "<summary>📊 LLMサマリー</summary>", ""]
USAGE_HEAD, UNFOLD = "- LLM使用量（内訳）:", ["", "</details>", ""]
WEEK_STAGES = [("weekly-clustering", "weekly-clustering（タスククラスタリング）"), ("weekly-summary", "weekly-summary（総括生成）")]
DAY_STAGES = [
    ("segment", "segment-llm（任意: enrich）"), ("hour", "hour-llm（タイムライン用）"), ("daily", "daily-llm（総括用）"),
    ("hour-enrich", "hour-enrich-llm（目的・意味付け）"),
]
NO_LOG = "（有効なログがありません。スクショ/OCR失敗が多い場合は、Screen Recording権限の付与先を確認してください）"


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(*parts: Column | str | None) -> Column:
    """Array of lines; a null line is left out."""
    cells = [F.lit(p) if isinstance(p, str) else p for p in parts if p is not None]
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def _when(cond: Column, *parts: Column | str) -> Column:
    return F.when(cond, _lines(*parts)).otherwise(F.array().cast("array<string>"))


def _usage_lines(stages: Sequence[tuple[str, str]], has_usage: bool) -> Column:
    """Usage per stage and in total from a map column ``usage``: stage to counters and cost."""
    if not has_usage:
        rows = [F.lit(f"  - {label}: {K.NOT_RUN}") for _, label in stages]
        return F.array(*rows, F.lit(f"  - {K.TOTAL}: input 0 / output 0 tokens（cost: n/a / n/a）"))
    u = F.col("usage")
    rows = [
        F.when(u[key].isNull(), F.lit(f"  - {label}: {K.NOT_RUN}")).otherwise(_join(
            f"  - {label}: ", usage_text(u[key]["input_tokens"], u[key]["cached_tokens"], u[key]["output_tokens"]),
            "（cost: ", cost_text(u[key]["cost_usd"]), "）",
            F.when(u[key]["model"] != "", _join(" / model ", u[key]["model"])).otherwise("")))
        for key, label in stages
    ]
    known = F.array(*[u[key] for key, _ in stages])
    some = F.filter(known, lambda x: x.isNotNull())
    zero = F.lit(0).cast("long")
    total = lambda f: F.aggregate(some, zero, lambda a, x: a + x[f])
    priced = F.filter(some, lambda x: x["cost_usd"].isNotNull())
    cost = F.when(F.size(priced) > 0, F.aggregate(priced, F.lit(0.0), lambda a, x: a + x["cost_usd"]))
    return F.array(*rows, _join(
        f"  - {K.TOTAL}: ", usage_text(total("input_tokens"), F.lit(0), total("output_tokens")), "（cost: ", cost_text(cost), "）"))


def _explode(df: DataFrame, by: Sequence[str], section: Column, sub: Column, lines: Column) -> DataFrame:
    return df.select(*by, section.alias("section"), sub.alias("sub"), F.posexplode(lines).alias("pos", "line"))


def as_document(lines: DataFrame, by: Sequence[str], out: str = "report") -> DataFrame:
    """One text per key, lines in order, no blank tail but a final line break.

    A report covers one day or one week of one source, so its lines are bounded.
    """
    rows = F.array_sort(F.collect_list(F.struct("section", "sub", "pos", "line")))
    return lines.groupBy(*by).agg(_join(
        F.regexp_replace(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), r"\s+$", ""), "\n").alias(out))


# ---- week --------------------------------------------------------------------------

def weekly_report_lines(
    meta: DataFrame, notes: DataFrame, summary: DataFrame, usage: DataFrame | None = None, variant: str | None = None
) -> DataFrame:
    """``source_id, week_start, section, sub, pos, line`` for every week.

    ``usage`` may give a map column ``usage`` per week.
    """
    by = W.WEEK
    head = meta.join(summary, by, "left")
    if usage is not None:
        head = head.join(usage.select(*by, "usage"), by, "left")
    span = _join(F.col("week_start").cast("string"), " 〜 ", week_end(F.col("week_start")).cast("string"))
    facts = [
        _join("- 対象期間: ", span), _join("- 推定総作業時間: ", duration_text(F.col("total_active_sec_est"))), "- 対象日数: 7日"]
    title = _join(WEEK_HEAD, F.col("week_start").cast("string"), " - ", week_end(F.col("week_start")).cast("string"))
    t = {c: F.trim(T.text_of(F.col(c))) for c in ("weekly_title", "weekly_summary", "weekly_detail")}
    hl = F.filter(F.coalesce("highlights", F.array().cast("array<string>")), lambda h: F.trim(h) != "")
    found = F.col("weekly_title").isNotNull() | F.col("weekly_summary").isNotNull()
    body = F.when(found, F.concat(
        _when(t["weekly_title"] != "", _join("- タイトル: ", t["weekly_title"])),
        _when(t["weekly_summary"] != "", _join("- 概要: ", t["weekly_summary"])),
        _when(t["weekly_detail"] != "", "", t["weekly_detail"]),
        _when(F.size(hl) > 0, "", "## 今週のハイライト", ""), F.transform(hl, lambda h: _join("- ", h)),
    )).otherwise(F.array(F.lit(K.WEEK_TEXTS["week_none"])))
    top = F.concat(
        _lines(title, "", F.lit(f"- 生成方式: {variant}") if variant else None, *facts, ""),
        _lines(*FOLD, *facts, USAGE_HEAD), _usage_lines(WEEK_STAGES, usage is not None), _lines(*UNFOLD),
        _lines("## 今週の総括", ""), body, _lines("", "## 日別ログ", ""))
    first = _explode(head, by, F.lit(0), F.lit(0), top)
    days = W.week_calendar(notes, meta.select(*by))
    over, detail = F.trim("overview"), F.trim("detail")
    day = F.concat(
        _lines(_join("### ", F.col("day").cast("string"), "（", weekday_name(F.col("day")), "）"), "",
               _join("- 推定作業時間: ", duration_text(F.col("total_active_sec_est")))),
        _when(over != "", "", over), _when((detail != "") & (detail != over), "", detail),
        _when((over == "") & (detail == ""), "", K.WEEK_TEXTS["day_none"]), _lines(""))
    rest = _explode(days, by, F.lit(1), F.datediff("day", "week_start"), day)
    return first.unionByName(rest)


def weekly_report_offline(snapshots: DataFrame, variant: str = "hour titles only") -> DataFrame:
    """The week report from hour titles and summaries alone, without any model."""
    notes = W.day_notes(snapshots)
    return weekly_report_lines(W.week_meta(snapshots), notes, W.week_summary_fallback(notes), variant=variant)


# ---- day -----------------------------------------------------------------------------

def daily_report_lines(
    counts: DataFrame, period: DataFrame, totals: DataFrame, hours: DataFrame, daily: DataFrame | None = None,
    usage: DataFrame | None = None, by: Sequence[str] = GROUP,
) -> DataFrame:
    """``by, section, sub, pos, line`` for every day.

    ``hours`` are rows of :func:`daymill.operators.hours.hour_timeline_rows` with
    ``hour_title``, ``hour_summary`` and ``cluster_labels``; ``daily`` holds day summaries.
    """
    by = list(by)
    per_hour = hours.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "hour_key", F.col("display_title").alias("title"), F.col("hour_summary").alias("summary"),
        F.col("display_summary").alias("shown")))).alias("_hours"))
    head = counts.join(period, by).join(totals, by, "left").join(per_hour, by, "left")
    if daily is not None:
        head = head.join(daily.select(*by, "daily_title", "daily_summary", "highlights"), by, "left")
    else:
        head = head.withColumn("daily_title", F.lit(None).cast("string")).withColumn(
            "daily_summary", F.lit(None).cast("string")).withColumn("highlights", F.lit(None).cast("array<string>"))
    if usage is not None:
        head = head.join(usage.select(*by, "usage"), by, "left")
    dt, ds = T.collapse(F.col("daily_title")), F.trim(T.text_of(F.col("daily_summary")))
    iso = F.col("day").cast("string")
    title = F.when(dt != "", _join(DAY_HEAD, F.substring(iso, 3, 8), "_", dt)).otherwise(_join(DAY_PLAIN, iso))
    wall = F.when(F.col("wall_sec") > 0, _join("（約", duration_text(F.col("wall_sec")), "）")).otherwise("")
    valid, full = duration_text(F.col("valid_sec")), duration_text(F.col("all_sec"))
    facts = _lines(
        _join("- 記録期間: ", F.date_format("first_ts", "HH:mm"), " 〜 ", F.date_format("last_ts", "HH:mm"), wall),
        _join("- キャプチャ数: ", F.col("total").cast("string"), "回（有効 ", F.col("valid").cast("string"), " / 除外 ",
              F.col("excluded").cast("string"), " / 失敗 ", F.col("errors").cast("string"), "）"),
        F.when((F.col("all_sec") > 0) & (F.col("all_sec") >= F.col("valid_sec")),
               _join("- 推定総時間: ", valid, "（有効分のみ） / ", full, "（除外・失敗も含む）"))
        .otherwise(_join("- 推定総時間: ", valid, "（有効分のみ）")),
        USAGE_HEAD)
    points = F.filter(F.coalesce("highlights", F.array().cast("array<string>")), lambda h: F.trim(h) != "")
    by_model = F.concat(
        _when(dt != "", _join("- 推定: ", F.trim("daily_title"))), _when(ds != "", _join("- 概要: ", ds)),
        _when(F.size(points) > 0, "", "### ハイライト", ""), F.transform(points, lambda h: _join("- ", h)))
    shown = F.array_distinct(F.filter(F.transform("_hours", lambda h: h["title"]), lambda x: (x != "") & (x != K.UNKNOWN_HOUR)))
    said = F.filter(F.transform("_hours", lambda h: T.shorten(h["summary"], 90)), lambda x: x != "")
    over = F.coalesce(F.get(said, F.lit(0)), F.get("_hours", F.lit(0))["shown"], F.lit(""))
    by_rule = F.when(F.coalesce(F.size(shown), F.lit(0)) > 0, F.concat(
        _lines(_join("- 推定: ", F.array_join(shown, " / "))), _when(over != "", _join("- 概要: ", over)),
        _lines("", "### ハイライト", ""), F.transform(shown, lambda h: _join("- ", h)))).otherwise(F.array(F.lit(NO_LOG)))
    top = F.concat(
        _lines(title, "", *FOLD), facts, _usage_lines(DAY_STAGES, usage is not None), _lines(*UNFOLD),
        _lines("## 本日のメイン作業（総括）", ""), F.when((dt != "") | (ds != ""), by_model).otherwise(by_rule),
        _lines("", "## タイムライン（推定・1時間）", ""), _when(F.coalesce(F.size("_hours"), F.lit(0)) == 0, "（有効なログがありません）"))
    quality = _lines("", "## 参考（データ品質）", "", _join("- 除外: ", F.col("excluded").cast("string"), "回"),
                     _join("- スクショ/OCR失敗: ", F.col("errors").cast("string"), "回"))
    hour = F.concat(
        _lines(_join("### ", F.substring("hour_start_ts", 12, 5), "〜", F.substring("hour_end_ts", 12, 5), "（推定稼働: ",
                     F.col("active_min").cast("string"), "分）"), "", _join("- 主な作業: ", F.col("display_title"))),
        _when(F.col("display_summary") != "", _join("- 概要: ", F.col("display_summary"))),
        _when(F.col("screens") != "", _join("- 主な作業画面: ", F.col("screens"))),
        _when(F.col("intent") != "", _join("- 推測される意図: ", F.col("intent"))), _lines(""))
    sub = F.lit(0).cast("long")
    return (
        _explode(head, by, F.lit(0), sub, top)
        .unionByName(_explode(hours, by, F.lit(1), F.unix_seconds(F.col("hour_key").cast("timestamp")), hour))
        .unionByName(_explode(head, by, F.lit(2), sub, quality))
    )


# ---- blocks ------------------------------------------------------------------------------

def report_blocks(df: DataFrame, by: Sequence[str], text: str, block_chars: int = K.BLOCK_CHARS) -> DataFrame:
    """Typed blocks of a report text: ``by, seq, block_batch, kind, content``.

    One pattern finds the blocks, a run of table lines counting as one, so a text is
    split inside its own row and nothing is shuffled.  A block longer than ``block_chars``
    continues in further blocks of its kind; headings stay whole.
    """
    units = F.filter(
        F.regexp_extract_all(F.col(text), F.lit(r"(?md)^(\|[^\n]*(?:\n\|[^\n]*)*+|[^\n]+)$"), F.lit(1)),
        lambda u: T.strip_ws(u) != "")
    kind = lambda u: (
        F.when(u.startswith("### "), "heading_3").when(u.startswith("## "), "heading_2").when(u.startswith("# "), "heading_1")
        .when(u.startswith("|"), "code").when(u.startswith("- "), "bulleted_list_item")
        .when(u.rlike(r"(?U)^\d+\.\s"), "numbered_list_item").otherwise("paragraph"))

    def content(u: Column, k: Column) -> Column:
        return (
            F.when(k == "code", u).when(k == "numbered_list_item", T.strip_ws(F.regexp_replace(u, r"(?U)^\d+\.\s", "")))
            .when(k == "paragraph", T.strip_ws(u)).otherwise(T.strip_ws(F.regexp_replace(u, "^(#{1,3}|-) ", ""))))

    def parts(k: Column, c: Column) -> Column:
        last = F.when(k.startswith("heading"), 0).otherwise(F.greatest(F.lit(0), F.floor((F.length(c) - 1) / block_chars).cast("int")))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            k.alias("kind"), F.when(k.startswith("heading"), c).otherwise(F.substr(c, i * block_chars + 1, F.lit(block_chars))).alias("content")))

    blocks = F.flatten(F.transform(units, lambda u: T.let(kind(u), lambda k: T.let(content(u, k), lambda c: parts(k, c)))))
    return df.select(*by, F.posexplode(blocks).alias("_i", "_b")).select(
        *by, (F.col("_i") + 1).alias("seq"), F.floor(F.col("_i") / K.BLOCKS_PER_BATCH).alias("block_batch"), "_b.kind", "_b.content")
