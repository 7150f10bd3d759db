"""Filters and exclusion rules."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import text as T
from daymill.operators.ordered import asof_latest, top_k


@dataclass(frozen=True)
class ExclusionRules:
    apps: Sequence[str] = field(default_factory=lambda: list(K.EXCLUDED_APPS))
    domain_keywords: Sequence[str] = field(default_factory=lambda: list(K.DOMAIN_KEYWORDS))
    text_keywords: Sequence[str] = field(default_factory=lambda: list(K.TEXT_KEYWORDS))


def valid_events(events: DataFrame) -> DataFrame:
    """Neither excluded nor failed, with a readable time."""
    off = F.coalesce(F.col("excluded"), F.lit(False)) | F.coalesce(F.col("has_error"), F.lit(False))
    return events.filter(~off & F.col("ts").isNotNull())


def exclusion_reason(
    app: Column, domain: Column, title: Column, preview: Column | None, rules: ExclusionRules
) -> Column:
    """Reason of the first matching rule, null when none matches.

    Order: app (any case), lock screen, domain keyword (any case), text keyword (exact
    case).  The rules are configuration, so they are folded into the expression: no join.
    """
    hay = F.concat(T.text_of(title), F.lit("\n"), T.text_of(preview) if preview is not None else F.lit(""))
    ranked = [("app", a) for a in rules.apps] + [("locked", K.LOCKED_APP)]
    ranked += [("domain_kw", k) for k in rules.domain_keywords] + [("text_kw", k) for k in rules.text_keywords]
    return first_rule(ranked, app, domain, hay)


def first_rule(ranked: Sequence[tuple[str, str]], app: Column, domain: Column, text: Column) -> Column:
    """Reason of the first rule (kind, pattern) that holds, null when none does.

    App rules are looked up by name.  The keywords of domains and of texts are each one pattern that shares their
    beginnings, so a text is read once however many there are.  Only the longest keyword of a place is reported;
    its rank is the lowest among the keywords that it begins with.  An app rule reports the app as the
    event spells it, a keyword rule reports the keyword.
    """
    rules = [(k, p) for k, p in ranked if p]
    name = T.strip_ws(T.text_of(app))
    row = F.struct(name.alias("name"), F.lower(name).alias("low"), F.lower(T.text_of(domain)).alias("host"), T.text_of(text).alias("text"))
    apps: dict[str, int] = {}
    hosts: dict[str, int] = {}
    words: dict[str, int] = {}
    for i, (kind, pattern) in enumerate(rules):
        held = apps if kind in ("app", "locked") else hosts if kind == "domain_kw" else words
        held.setdefault(pattern if held is words else pattern.lower(), i)
    table = F.from_json(F.lit(json.dumps([{"kind": k, "pattern": p} for k, p in rules])), "array<struct<kind:string,pattern:string>>")

    def search(e: Column) -> Column:
        ranks = F.array(_rank_of(apps, e["low"]), _first_keyword(hosts, e["host"]), _first_keyword(words, e["text"]))
        return T.let(F.get(table, F.array_min(ranks)), lambda r: F.concat(
            r["kind"], F.lit(":"), F.when(r["kind"] == "app", e["name"]).otherwise(r["pattern"])))

    return T.let(row, search)


def _rank_of(ranks: dict[str, int], key: Column) -> Column:
    if not ranks:
        return F.lit(None).cast("int")
    return F.try_element_at(F.from_json(F.lit(json.dumps(ranks)), "map<string,int>"), key)


def _first_keyword(ranks: dict[str, int], text: Column) -> Column:
    """Lowest rank of the keywords that ``text`` holds."""
    if not ranks:
        return F.lit(None).cast("int")
    lowest = {k: min(r for j in range(1, len(k) + 1) if (r := ranks.get(k[:j])) is not None) for k in ranks}
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({keyword_pattern(ranks)}))"), F.lit(1)))
    return F.array_min(F.transform(hits, lambda k: _rank_of(lowest, k)))


def keyword_pattern(keywords: Sequence[str]) -> str:
    """A pattern that finds the longest of ``keywords`` at a place, one branch for each shared beginning."""
    quoted = lambda c: c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"

    def branch(words: list[str], at: int) -> str:
        """Continuations of ``words``, which agree in their first ``at`` characters."""
        out, i = [], int(len(words[0]) == at)
        ends = i == 1
        while i < len(words):
            j = i
            while j < len(words) and words[j][at] == words[i][at]:
                j += 1
            same = at + 1  # as far as all agree
            while same < len(words[i]) and words[j - 1][:same + 1] == words[i][:same + 1]:
                same += 1
            rest = branch(words[i:j], same) if j - i > 1 or len(words[i]) > same else ""
            out.append((words[i][at], "".join(map(quoted, words[i][at:same])) + rest))
            i = j
        if not out:
            return ""
        body = f"(?:{either(out)})" if len(out) > 1 or ends else out[0][1]
        return body + ("?" if ends else "")

    def either(parts: list[tuple[str, str]]) -> str:
        """Alternatives by their first character; many are split in groups that one character chooses."""
        if len(parts) <= 6:
            return "|".join(p for _, p in parts)
        size = -(-len(parts) // 6)
        groups = [parts[i:i + size] for i in range(0, len(parts), size)]
        return "|".join(f"(?=[{''.join(quoted(c) for c, _ in g)}])(?:{either(g)})" for g in groups)

    words = sorted(set(keywords))
    firsts = "".join(quoted(c) for c in sorted({w[0] for w in words}))
    return f"(?=[{firsts}]){branch(words, 0)}"


def exclude_by_rules(df: DataFrame, rules: ExclusionRules, preview: str | None = None) -> DataFrame:
    """Adds ``rule_reason`` and ``rule_excluded`` from app, domain, title and preview."""
    why = exclusion_reason(
        F.col("active_app"), F.col("browser.domain"), F.col("window_title"),
        F.col(preview) if preview else None, rules,
    )
    return df.withColumn("rule_reason", why).withColumn("rule_excluded", F.col("rule_reason").isNotNull())


def match_rules(df: DataFrame, rules: DataFrame, app: Column, domain: Column, text: Column) -> DataFrame:
    """First matching row of a rule table ``(kind, pattern, rank)`` per row of ``df``.

    A rule table is configuration; :func:`first_rule` searches all its rules at once inside the row, so rows
    never multiply.
    """
    found = sorted(rules.select("kind", "pattern", "rank").collect(), key=lambda r: (r["rank"], r["kind"], r["pattern"]))
    return df.withColumn("rule_reason", first_rule([(r["kind"], r["pattern"]) for r in found], app, domain, text))


def exclude_two_stage(
    events: DataFrame, rules: ExclusionRules, preview_chars: int | None = None
) -> DataFrame:
    """Metadata first, then every display's text; see :func:`rollup_display_exclusion`.

    Stage 1 hits become stubs.  Stage 2 looks at the text of each display (its first
    ``preview_chars`` characters, if given), blanks the excluded ones and keeps their reason.
    """
    meta = exclusion_reason(
        F.col("active_app"), F.col("browser.domain"), F.col("window_title"), None, rules
    )

    def shown(d: Column) -> Column:
        whole = T.text_of(d["ocr_text"])
        return whole if preview_chars is None else F.substring(whole, 1, preview_chars)

    def judge(d: Column) -> Column:
        why = exclusion_reason(
            F.col("active_app"), F.col("browser.domain"), F.col("window_title"),
            shown(d), rules,
        )
        return T.let(why, lambda r: F.struct(
            d["display"].alias("display"),
            F.when(r.isNull(), d["ocr_text"]).otherwise(F.lit("")).alias("ocr_text"),
            r.isNotNull().alias("excluded"), r.alias("excluded_reason"),
        ))

    staged = events.withColumn("_meta", meta).withColumn(
        "ocr_by_display",
        F.when(F.col("_meta").isNotNull(), F.array().cast(events.schema["ocr_by_display"].dataType))
        .otherwise(F.transform("ocr_by_display", judge)),
    )
    rolled = rollup_display_exclusion(staged)
    stub = F.col("_meta").isNotNull()
    url = F.when(F.col("browser").isNotNull(), F.struct(
        F.col("browser.name").alias("name"),
        F.when(stub, F.lit("")).otherwise(F.col("browser.url")).alias("url"),
        F.col("browser.domain").alias("domain"),
    ))
    return (
        rolled.withColumn("excluded", stub | F.col("excluded"))
        .withColumn("excluded_reason", F.coalesce("_meta", "excluded_reason"))
        .withColumn("window_title", F.when(stub, K.REDACTED_TITLE).otherwise(F.col("window_title")))
        .withColumn("browser", url).withColumn("ocr_text", F.when(stub, F.lit("")).otherwise(F.col("ocr_text")))
        .drop("_meta")
    )


def rollup_display_exclusion(events: DataFrame) -> DataFrame:
    """Event-level exclusion from its displays, and the active display lifted out."""
    disp = F.col("ocr_by_display")
    flag = lambda d: F.coalesce(d["excluded"], F.lit(False))
    all_off = (F.size(disp) > 0) & F.forall(disp, flag)
    reasons = F.array_sort(F.array_distinct(F.filter(
        F.transform(disp, lambda d: d["excluded_reason"]), lambda r: r.isNotNull() & (r != ""))))
    active = F.get(F.filter(disp, lambda d: d["display"] == F.col("active_display")), F.lit(0))
    return (
        events.withColumn("excluded", F.coalesce(all_off, F.lit(False)))
        .withColumn("excluded_reason", F.when(F.col("excluded") & (F.size(reasons) > 0), F.array_join(reasons, ",")))
        .withColumn("_active", active)
        .withColumn("ocr_active_display_excluded", F.when(F.col("_active").isNotNull(), flag(F.col("_active"))))
        .withColumn("ocr_active_display_text", F.when(
            F.col("ocr_active_display_excluded") == F.lit(False), T.text_of(F.col("_active.ocr_text"))).otherwise(F.lit("")))
        .withColumn("ocr_active_display_excluded_reason", F.when(
            F.col("ocr_active_display_excluded"), F.nullif(F.col("_active.excluded_reason"), F.lit(""))))
        .drop("_active")
    )


def drop_asleep_captures(
    captures: DataFrame, power: DataFrame, tolerance_sec: int = K.SLEEP_TOLERANCE_SEC
) -> DataFrame:
    """Drop captures whose latest power event is a sleep state no older than the tolerance."""
    near = asof_latest(captures, power, ["source_id"], "power_state", tolerance_sec)
    asleep = F.coalesce(F.col("power_state").isin(K.SLEEP_STATES), F.lit(False))
    return near.filter(~asleep).drop("power_state", "power_state_ts")


def eligible_hours(
    hours: DataFrame, by: Sequence[str], min_sec: int = K.HOUR_MIN_SEC, max_hours: int | None = None
) -> DataFrame:
    """Hours with enough activity; with ``max_hours``, the most active of them."""
    enough = hours.filter(F.col("active_sec_est") >= min_sec)
    if not max_hours:
        return enough
    return top_k(enough, by, [F.desc("active_sec_est"), F.col("hour_key")], max_hours, "_rank").drop("_rank")


def snapshot_usable(snapshots: DataFrame) -> DataFrame:
    """Adds ``usable``: complete, or with any hour or daily content."""
    daily = F.col("daily")
    content = F.coalesce(F.size("hours") > 0, F.lit(False)) | F.coalesce(daily.isNotNull(), F.lit(False))
    return snapshots.withColumn("usable", (F.trim(T.text_of(F.col("status"))) == "complete") | content)


def due_retries(ledger: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Ledger rows whose next attempt is blank, unreadable or not in the future."""
    moment = now if isinstance(now, Column) else F.lit(now)
    due = F.col("next_retry_after").try_cast("timestamp")
    return ledger.filter(due.isNull() | (due <= moment))
