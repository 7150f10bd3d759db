"""Text of a segment: what repeats, what is new, and keywords.

A sentence is common in (segment, display) when at least two display entries hold it.
One that is not common therefore occurs in exactly one entry, so "new text" needs no
ordered state: a count and a minimum position per sentence decide everything.  A segment's
display of many texts is counted in parts, by the hash of the sentence.

Sentences are counted by keys of fixed size (hashes of 64 and 32 bits within the segment's display; sentences that
agree in both count as one).  An entry shuffles its keys as one row, 12 bytes a sentence, and the sentences first seen in it
go back to its event as bits of 64 positions; the text of an entry is never part of a stage and is read again where it is asked for.

Whole texts are counted first, by two hashes in the same way.  Where the entries of a segment's display
show one text only, its sentences all have the count of the text and stand in its first entry, so no
sentence is shuffled; elsewhere each distinct text gives its sentences once, weighted by its count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import text as T
from daymill.operators.context import display_entries
from daymill.operators.ordered import GROUP, SLICE_SEC, time_slice, top_k
from daymill.session import dealt

SEGMENT = [*GROUP, "segment_id"]
PLACE = [*SEGMENT, "display"]
EVENT = [*GROUP, "ingest_seq"]

#: Texts of a segment's display that are counted in one part, and parts at most.
PART_TEXTS, PARTS = 4096, 32


def traced_events(trace: DataFrame) -> DataFrame:
    """Narrow rows of the events that resolve to a segment."""
    return trace.filter(F.col("segment_id").isNotNull()).select(
        *EVENT, "segment_id", "segment_key", "id", "ts", "local_ts", "tz_offset_sec")


def text_entries(shown: DataFrame) -> DataFrame:
    """Display entries that carry text, of events with their text; other columns stay.

    ``leads`` marks the first entry with text of an event's display.
    """
    before = F.slice("ocr_by_display", F.lit(1), F.col("entry_pos"))
    same = lambda d: F.coalesce(d["display"], F.lit(-1)) == F.col("display")
    text = lambda d: F.when(same(d), T.entity_text(d["ocr_text"]) != "").otherwise(F.lit(False))
    keep = [c for c in shown.columns if c not in ("active_display", "ocr_text", "ocr_active_display_text")]
    rows = display_entries(shown.filter(F.size("ocr_by_display") > 0), *keep)
    return rows.withColumn("display", F.coalesce("display", F.lit(-1))).filter(F.col("ocr_text") != "").withColumn(
        "leads", ~F.exists(before, text)).drop("ocr_by_display")


def text_places(entries: DataFrame) -> DataFrame:
    """Narrow rows of entries with text: two hashes of the text, and ``said``, whether its first sentence is not empty."""
    return entries.withColumns({
        "t1": F.xxhash64("ocr_text"), "t2": F.xxhash64(F.lit(1), "ocr_text"),
        "said": T.first_sentence(F.col("ocr_text")) != ""}).drop("ocr_text")


def text_counts(places: DataFrame) -> DataFrame:
    """One narrow row per distinct text of a segment's display, at the first entry showing it.

    ``n`` counts the entries showing it and ``rows`` those at this very place (above one where events repeat).
    """
    texts = places.groupBy(*PLACE, "t1", "t2", "ts", "ingest_seq", "entry_pos").agg(F.count(F.lit(1)).alias("rows")).groupBy(
        *PLACE, "t1", "t2").agg(F.sum("rows").alias("n"), F.min(F.struct("ts", "ingest_seq", "entry_pos", "rows")).alias("first"))
    return texts.select(*PLACE, "t1", "t2", "n", "first.ingest_seq", "first.entry_pos", "first.rows")


def with_texts(where: DataFrame, counts: DataFrame) -> DataFrame:
    """Events with ``texts``: the entries that show a text first, with its counts, whether it is ``alone`` and the
    ``parts`` in which the sentences of its segment's display are counted."""
    other = counts.groupBy(*PLACE).agg(
        ((F.min("t1") == F.max("t1")) & (F.min("t2") == F.max("t2"))).alias("alone"),
        F.least(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / PART_TEXTS)).cast("int").alias("parts"))
    found = counts.drop("t1", "t2").join(other, PLACE).groupBy(*EVENT).agg(
        F.collect_list(F.struct("entry_pos", "n", "rows", "alone", "parts")).alias("texts"))
    none = F.array().cast("array<struct<entry_pos:int,n:bigint,rows:bigint,alone:boolean,parts:int>>")
    return where.join(found, EVENT, "left").withColumn("texts", F.coalesce("texts", none))


def with_others(shown: DataFrame) -> DataFrame:
    """Only the texts that are not alone in their segment's display, and the events that have some."""
    return shown.withColumn("texts", F.filter("texts", lambda t: ~t["alone"])).filter(F.size("texts") > 0)


def entry_sentences(entries: DataFrame) -> DataFrame:
    """One row per part of an entry in ``texts``: the keys ``h1, h2`` of its distinct sentences in order, ``skipped``, the sentences
    passed over before each, and ``n``, the entries that show this text (shared by the rows at the place)."""
    first = entries.withColumn("_t", F.get(F.filter("texts", lambda t: t["entry_pos"] == F.col("entry_pos")), F.lit(0))).filter(F.col("_t").isNotNull())
    many = F.col("_t.parts") > 1
    split = lambda a: F.transform(F.sequence(F.lit(0), F.col("_t.parts") - 1), lambda p: F.struct(
        p.alias("part"), F.filter(a, lambda k: F.pmod(k["h1"], F.col("_t.parts")) == p).alias("keys")))
    parts = T.let(T.sentence_keys(F.col("ocr_text")), lambda a: F.when(many, F.filter(split(a), lambda p: F.size(p["keys"]) > 0)).otherwise(
        F.array(F.struct(F.lit(0).alias("part"), a.alias("keys")))))
    of = lambda get: F.transform("_p.keys", get)
    return first.select(
        *PLACE, "ts", "ingest_seq", "entry_pos", (F.col("_t.n") / F.col("_t.rows")).alias("n"), F.hash("ocr_text").alias("t"), F.explode(parts).alias("_p")).select(
        *PLACE, "_p.part", "ts", "ingest_seq", "entry_pos", "n", "t", of(lambda k: k["h1"]).alias("h1"),
        of(lambda k: k["h2"]).alias("h2"), of(lambda k, i: k["pos"] - i).alias("skipped"))


def sentence_counts(sentences: DataFrame) -> DataFrame:
    """Entries holding each sentence, with the first place it was seen."""
    at = dealt(sentences, *PLACE, "part").select(
        *PLACE, "part", "ts", "ingest_seq", "entry_pos", "n", "t", F.col("h2").alias("_h2"), "skipped", F.posexplode("h1").alias("_i", "_h1"))
    rows = at.select(
        *PLACE, "part", F.col("_h1").alias("h1"), F.get("_h2", F.col("_i")).alias("h2"), "n",
        F.struct("ts", "ingest_seq", "entry_pos", (F.col("_i") + F.get("skipped", F.col("_i"))).alias("pos"), "t").alias("place"))
    return rows.groupBy("h1", "h2", *PLACE, "part").agg(F.round(F.sum("n")).cast("long").alias("entries"), F.min("place").alias("first"))


def with_places(where: DataFrame, counts: DataFrame) -> DataFrame:
    """Events with ``places``: where the sentences first seen in them stand, as ``bits`` of 64 positions, and the entries holding each.

    Of ``texts`` only those alone stay: all their sentences are first seen there, in as many entries.
    """
    pos = F.col("first.pos")
    words = counts.groupBy(  # by the keys that the counts are dealt by, so nothing is shuffled
        *PLACE, "part", "first.ingest_seq", "first.entry_pos", "first.t", "entries", F.shiftright(pos, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), pos.bitwiseAND(63))).alias("bits"))
    found = words.groupBy(*EVENT).agg(F.collect_list(F.struct("entry_pos", "entries", "word", "bits")).alias("places"))
    none = F.array().cast("array<struct<entry_pos:int,entries:bigint,word:int,bits:bigint>>")
    return where.withColumn("texts", F.filter("texts", lambda t: t["alone"])).join(found, EVENT, "left").withColumn(
        "places", F.coalesce("places", none))


def with_common(placed: DataFrame) -> DataFrame:
    """Only the places and texts of common sentences, and the events that have some."""
    return placed.withColumn("places", F.filter("places", lambda p: p["entries"] >= 2)).withColumn(
        "texts", F.filter("texts", lambda t: t["n"] >= 2)).filter((F.size("places") > 0) | (F.size("texts") > 0))


def first_sentences(shown: DataFrame) -> DataFrame:
    """One row per entry of events with places and text: ``firsts``, the sentences first seen in it (``pos, entries,
    text``), and ``lead``, its first sentence if it is the event's first entry of the display.
    """
    here = lambda c: F.filter(c, lambda x: x["entry_pos"] == F.col("entry_pos"))
    rows = text_entries(shown)
    return rows.select(
        *(c for c in rows.columns if c not in ("ocr_text", "places", "texts", "leads")), F.when(F.col("leads"), T.first_sentence(F.col("ocr_text"))).alias("lead"),
        T.sentences_at(F.col("ocr_text"), here("places"), F.get(here("texts"), F.lit(0))["n"]).alias("firsts"))


def counted_sentences(firsts: DataFrame) -> DataFrame:
    """One row per sentence of a segment's display: entries holding it, its first place and its text there."""
    return firsts.select(*PLACE, "ts", "ingest_seq", "entry_pos", F.explode("firsts").alias("_s")).select(
        *PLACE, "ts", "ingest_seq", "entry_pos", "_s.pos", "_s.entries", "_s.text")


def segment_common_texts(firsts: DataFrame, limit: int | None = None) -> DataFrame:
    """Common sentences per place, most frequent first, then first seen."""
    held = firsts.withColumn("firsts", F.filter("firsts", lambda s: s["entries"] >= 2))
    order = [F.desc("entries"), *map(F.col, ("ts", "ingest_seq", "entry_pos", "pos"))]
    return top_k(counted_sentences(held), PLACE, order, limit).select(*PLACE, "rank", "text", "entries")


def with_shown(placed: DataFrame, first: DataFrame) -> DataFrame:
    """Events of ``placed`` that ``first`` names, with its ``rank`` and ``shown``, what tells their row there from others of the event."""
    own = F.struct("display", "id", "ts", "segment_key").alias("shown")
    return placed.join(first.select(*EVENT, F.col("segment_id").alias("_segment"), "rank", own), EVENT).filter(
        F.col("segment_id") == F.col("_segment")).drop("_segment")


def shown_texts(rows: DataFrame) -> DataFrame:
    """:func:`segment_new_texts` of the displays named by :func:`with_shown`, with their ``rank``."""
    firsts = first_sentences(rows)
    return segment_new_texts(firsts.filter(F.struct("display", "id", "ts", "segment_key").eqNullSafe(F.col("shown"))), "rank")


def segment_new_texts(firsts: DataFrame, *keep: str) -> DataFrame:
    """Text each event adds on a display: its unique sentences, else its first one."""
    fresh = F.array_join(F.transform(F.filter("firsts", lambda s: s["entries"] == 1), lambda s: s["text"]), " / ")
    text = F.array(F.coalesce(F.nullif(fresh, F.lit("")), F.col("lead")))
    return firsts.filter(F.col("lead").isNotNull()).select(
        *PLACE, "ingest_seq", "segment_key", "id", "ts", "local_ts", "tz_offset_sec", "is_active_display", *keep,
        F.explode(F.filter(text, lambda t: t != "")).alias("ocr_text"))  # a filter on the column would make the text twice


def new_text_places(places: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of :func:`segment_new_texts` without their text: entries that lead their display and say something."""
    rows = places.filter("leads").select(
        *PLACE, "ingest_seq", "segment_key", "id", "ts", "local_ts", "tz_offset_sec", "is_active_display", "said", "entry_pos")
    fresh = placed.select(*EVENT, F.concat(
        F.transform(F.filter("texts", lambda t: t["n"] == 1), lambda t: t["entry_pos"]),
        F.transform(F.filter("places", lambda p: p["entries"] == 1), lambda p: p["entry_pos"])).alias("_fresh")).dropDuplicates(EVENT)
    mute = rows.filter(~F.col("said")).join(fresh, EVENT).filter(F.expr("array_contains(_fresh, entry_pos)")).select(*rows.columns)
    return rows.filter("said").unionByName(mute).drop("said", "entry_pos")


def segment_span(trace: DataFrame) -> DataFrame:
    """First and last time of a segment's events."""
    return trace.filter(F.col("segment_id").isNotNull()).groupBy(*SEGMENT).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))


def top_keywords(
    df: DataFrame, by: Sequence[str], text: str, limit: int = 8, order: str | None = None
) -> DataFrame:
    """Most frequent keyword tokens per group, ties by first appearance.

    ``by`` may name one text per row (its key) or a whole segment; counting is partial.
    """
    seq = F.col(order) if order else F.lit(0)
    hits = df.select(*by, seq.alias("_o"), F.posexplode(T.keyword_hits(F.col(text))).alias("_p", "token"))
    counts = hits.filter(F.col("token") != "").groupBy(*by, "token").agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.struct("_o", "_p")).alias("_at"))
    return top_k(counts, by, [F.desc("hits"), F.col("_at")], limit).drop("_at")


def with_lone(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Narrow sessions with ``lone``: whether the event is the only one of its segment and does not repeat in ``events``, and
    ``parts``, in which the keywords of its segment are counted."""
    n = F.count(F.lit(1))
    size = sessions.groupBy(*SEGMENT).agg((n == 1).alias("_one"), F.least(F.lit(PARTS), F.ceil(n / PART_TEXTS)).cast("int").alias("parts"))
    again = events.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*EVENT, F.lit(True).alias("_again"))
    return sessions.join(size, SEGMENT).join(again, EVENT, "left").withColumn(
        "lone", F.col("_one") & F.col("_again").isNull()).drop("_one", "_again")


def _lone_top(sessions: DataFrame, found: Column, name: str, limit: int) -> DataFrame:
    """Top distinct values of segments of one event: each has one hit and stands in order, so nothing is shuffled."""
    return sessions.select(*SEGMENT, F.posexplode(F.slice(found, 1, limit)).alias("_p", name)).select(
        *SEGMENT, name, F.lit(1).cast("long").alias("hits"), (F.col("_p") + 1).alias("rank"))


def lone_keywords(sessions: DataFrame, text: str = "primary_text", limit: int = 8) -> DataFrame:
    """:func:`segment_keywords` of segments that have one event."""
    hits = F.filter(F.array_distinct(T.keyword_hits(F.col(text))), lambda t: t != "")
    return _lone_top(sessions, hits, "token", limit)


def lone_snippets(sessions: DataFrame, text: str = "primary_text", limit: int = 3) -> DataFrame:
    """:func:`segment_snippets` of segments that have one event."""
    return _lone_top(sessions, T.rank_snippets(F.col(text)), "snippet", limit)


def in_order(sessions: DataFrame) -> DataFrame:
    """Narrow sessions with ``order``, a number that grows with ``ts`` and ``ingest_seq`` within a segment.

    Events are ranked within time slices of the day, so no task sorts a segment.
    """
    piece = time_slice(F.col("ts")) - F.unix_date("day") * (86400 // SLICE_SEC)
    at = Window.partitionBy(*SEGMENT, "_slice").orderBy("ts", "ingest_seq")
    return sessions.withColumn("_slice", piece.cast("long")).withColumn(
        "order", F.shiftleft("_slice", 26) + F.rank().over(at)).drop("_slice")


def segment_keywords(sessions: DataFrame, text: str = "primary_text", limit: int = 8) -> DataFrame:
    """Top keywords of each segment over the distinct keywords of its events.

    An event's keywords are shuffled as one row and counted where they meet, without a sort: their place is one number, of
    the event's ``order`` and 20 bits.  Those of a segment of many events are counted in ``parts``, by their hash.
    """
    rows = sessions if "order" in sessions.columns else in_order(sessions)
    parts = F.col("parts") if "parts" in sessions.columns else F.lit(1)
    split = lambda a: F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(
        p.alias("part"), F.filter(a, lambda k: F.pmod(F.xxhash64(k["token"]), parts) == p).alias("keys")))
    token = F.transform(F.array_distinct(T.keyword_hits(F.col(text))), lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    found = T.let(F.filter(token, lambda k: k["token"] != ""), lambda a: F.filter(
        F.when(parts > 1, split(a)).otherwise(F.array(F.struct(F.lit(0).alias("part"), a.alias("keys")))), lambda p: F.size(p["keys"]) > 0))
    packed = rows.select(*SEGMENT, "order", F.explode(found).alias("_p")).select(
        *SEGMENT, "_p.part", "order", F.array_join(F.transform("_p.keys", lambda k: k["token"]), "\n").alias("tokens"),
        F.transform("_p.keys", lambda k, i: k["pos"] - i).alias("skipped"))
    hits = dealt(packed, *SEGMENT, "part").select(
        *SEGMENT, "part", "order", "skipped", F.posexplode(F.split("tokens", "\n")).alias("_i", "token"))
    place = F.least(F.col("_i") + F.get("skipped", F.col("_i")), F.lit((1 << 20) - 1))
    counts = hits.groupBy(*SEGMENT, "part", "token").agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.shiftleft("order", 20) + place).alias("_at"))
    return top_k(counts, SEGMENT, [F.desc("hits"), F.col("_at")], limit).drop("_at", "part")


def segment_snippets(sessions: DataFrame, text: str = "primary_text", limit: int = 3) -> DataFrame:
    """Most frequent snippets of each segment."""
    hits = sessions.select(*SEGMENT, "ts", "ingest_seq", F.posexplode(T.rank_snippets(F.col(text))).alias("_p", "snippet"))
    counts = hits.groupBy(*SEGMENT, "snippet").agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.struct("ts", "ingest_seq", "_p")).alias("_at"))
    return top_k(counts, SEGMENT, [F.desc("hits"), F.col("_at")], limit).drop("_at")
