"""Time and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daymill.functions import fixed as K


_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(?:([+-])(\d{2}):?(\d{2})|Z)?$"


def offset_seconds(iso: Column) -> Column:
    """UTC offset of an ISO-8601 string; 0 when it has none."""
    sign = F.when(F.regexp_extract(iso, _ISO, 3) == "-", -1).otherwise(1)
    hours = F.regexp_extract(iso, _ISO, 4).try_cast("int")
    minutes = F.regexp_extract(iso, _ISO, 5).try_cast("int")
    return F.coalesce(sign * (hours * 3600 + minutes * 60), F.lit(0))


def parse_local(iso: Column) -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) of an ISO string, null when malformed."""
    wall = F.concat_ws(" ", F.regexp_extract(iso, _ISO, 1), F.regexp_extract(iso, _ISO, 2))
    return F.when(iso.rlike(_ISO), wall).try_cast("timestamp_ntz")


def shift_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def parse_instant(iso: Column) -> Column:
    """Instant of an ISO string as UTC wall-clock (TIMESTAMP_NTZ)."""
    return shift_seconds(parse_local(iso), -offset_seconds(iso))


def hour_start(local_ts: Column) -> Column:
    """Start of the hour of a TIMESTAMP_NTZ, as TIMESTAMP_NTZ."""
    return F.date_trunc("hour", local_ts).cast("timestamp_ntz")


def hour_key(local_ts: Column, offset_sec: Column) -> Column:
    """Hour bucket as an instant: events of one wall hour and offset share it."""
    return shift_seconds(hour_start(local_ts), -F.coalesce(offset_sec, F.lit(0)))


def offset_text(offset_sec: Column) -> Column:
    o = F.coalesce(offset_sec, F.lit(0))
    a = F.abs(o)
    return F.format_string(
        "%s%02d:%02d", F.when(o < 0, "-").otherwise("+"),
        F.floor(a / 3600).cast("int"), F.floor((a % 3600) / 60).cast("int"),
    )


def iso_text(local_ts: Column, offset_sec: Column) -> Column:
    return F.concat(F.date_format(local_ts, "yyyy-MM-dd'T'HH:mm:ss"), offset_text(offset_sec))


def hour_end_text(hour_start_text: Column) -> Column:
    """``…:00:00+09:00`` becomes ``…:59:59+09:00``."""
    return F.concat(F.substring(hour_start_text, 1, 14), F.lit("59:59"), F.substring(hour_start_text, 20, 20))


def duration_text(sec: Column) -> Column:
    """``H時間M分``, or ``M分`` below an hour."""
    h, m = F.floor(sec / 3600), F.floor((sec % 3600) / 60)
    mins = F.concat(m.cast("string"), F.lit("分"))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("時間"), mins)).otherwise(mins)


def last_seen_text(local_ts: Column) -> Column:
    return F.coalesce(F.date_format(local_ts, "yy/MM/dd H:mm"), F.lit("-"))


def usage_tier(sec: Column, top: Column) -> Column:
    share = sec / top
    return (
        F.when(top <= 0, K.TIER_LOW)
        .when((sec == top) & (sec > 0), K.TIER_TOP)
        .when(share >= 0.66, K.TIER_HIGH)
        .when(share >= 0.33, K.TIER_MID)
        .otherwise(K.TIER_LOW)
    )


def int_text(n: Column) -> Column:
    return F.format_number(n, 0)


def usd_text(cost: Column) -> Column:
    """``$0.000072``; rounds the exact binary value, half to even."""
    plain = F.replace(F.format_number(cost, 6), F.lit(","), F.lit(""))
    return F.coalesce(F.concat(F.lit("$"), plain), F.lit("n/a"))


def jpy_text(cost: Column, rate: float = K.USD_TO_JPY) -> Column:
    yen = F.bround(cost * F.lit(float(rate)), 0).cast("long")
    return F.coalesce(F.concat(F.lit("¥"), F.format_number(yen, 0)), F.lit("n/a"))


def cost_text(cost: Column) -> Column:
    return F.concat(usd_text(cost), F.lit(" / "), jpy_text(cost))


def week_start(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def week_end(day: Column) -> Column:
    return F.date_add(week_start(day), 6)


def previous_week_start(today: Column) -> Column:
    return F.date_sub(week_start(today), 7)


def is_monday(day: Column) -> Column:
    return F.weekday(day) == 0


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in K.WEEKDAYS]), F.weekday(day) + 1)


def usage_tokens(doc: Column) -> Column:
    """struct(input, output, cached) from a usage JSON string with either key style.

    Null when neither style is present; cached is clamped to [0, input].
    """

    def read(path: str) -> Column:
        return F.try_variant_get(F.try_parse_json(doc), path, "bigint")

    def has(path: str) -> Column:
        return F.get_json_object(doc, path).isNotNull()

    new_style = has("$.input_tokens") | has("$.output_tokens")
    old_style = has("$.prompt_tokens") | has("$.completion_tokens")
    inp = F.when(new_style, F.coalesce(read("$.input_tokens"), F.lit(0))).otherwise(
        F.coalesce(read("$.prompt_tokens"), F.lit(0)))
    out = F.when(new_style, F.coalesce(read("$.output_tokens"), F.lit(0))).otherwise(
        F.coalesce(read("$.completion_tokens"), F.lit(0)))
    cached = F.coalesce(read("$.input_tokens_details.cached_tokens"), F.lit(0))
    return F.when(
        new_style | old_style,
        F.struct(
            inp.alias("input_tokens"), out.alias("output_tokens"),
            F.greatest(F.lit(0), F.least(cached, inp)).alias("cached_tokens"),
        ),
    )


def effective_interval(raw: Column, default: Column) -> Column:
    """The row's own interval when it is a non-zero number, else the default."""
    own = F.nullif(raw.try_cast("int"), F.lit(0))
    return F.coalesce(own, default, F.lit(K.DEFAULT_INTERVAL_SEC))
