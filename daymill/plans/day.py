"""The day job: events to segments, segment texts and hour packs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymill.operators import hours as H
from daymill.operators import sessions as S
from daymill.operators import texts as X
from daymill.operators.context import select_primary_text
from daymill.session import dealt, staged

TEXT = ["ocr_text", "ocr_active_display_text", "ocr_by_display"]
AT = ["source_id", "day", "ingest_seq"]


def _kept(df: DataFrame, name: str) -> DataFrame:
    return staged(df, name, "zstd", clean=True)


@dataclass
class DayJob:
    """Stages over one table of events; each property is one DataFrame.

    ``keep`` receives every stage that several later stages read.  The default writes
    it to the shared folder once; pass ``lambda df, name: df`` for one lazy plan.  Stages up to
    the timeline are narrow: the text of entries is looked up again for the rows that need it.

    ``lookup`` joins narrow rows to the events' text by their place in the log and gives the
    rows' columns with ``active_display`` and the text columns.  The default joins ``events``; where
    these are a join themselves, ``lookup`` can join the narrow rows first and so shuffle no text.
    """

    events: DataFrame
    keep: Callable[[DataFrame, str], DataFrame] = _kept
    lookup: Callable[[DataFrame], DataFrame] | None = None

    def with_text(self, rows: DataFrame) -> DataFrame:
        """Narrow ``rows`` with the text that their events show."""
        if self.lookup is not None:
            return self.lookup(rows)
        held = [c for c in ("active_display", *TEXT) if c in self.events.columns and c not in rows.columns]
        return dealt(rows, *X.EVENT).join(dealt(self.events.select(*X.EVENT, *held), *X.EVENT), X.EVENT)

    @cached_property
    def timed(self) -> DataFrame:
        return S.with_effective_interval(self.keep(self.events.drop(*TEXT), "narrow_events"))

    @cached_property
    def narrow_sessions(self) -> DataFrame:
        return self.keep(S.sessionize_timed(self.timed), "sessions")

    @cached_property
    def sessions(self) -> DataFrame:
        """Sessions with text: cut on narrow rows, joined on the event's place in its log."""
        return self.with_text(self.narrow_sessions) if any(c in self.events.columns for c in TEXT) else self.narrow_sessions

    @cached_property
    def lone(self) -> DataFrame:
        return self.keep(X.in_order(X.with_lone(self.narrow_sessions, self.timed)), "lone")

    def _primary(self, lone: bool) -> DataFrame:
        """Sessions of segments of one event, or of more, with their primary text."""
        rows = self.lone.filter(F.col("lone") == lone).drop("lone")
        return select_primary_text(self.with_text(rows))

    @property
    def keywords(self) -> DataFrame:
        """Top keywords of each segment; segments of one event are not shuffled."""
        return X.segment_keywords(self._primary(False)).unionByName(X.lone_keywords(self._primary(True)))

    @property
    def snippets(self) -> DataFrame:
        """Top snippets of each segment; segments of one event are not shuffled."""
        return X.segment_snippets(self._primary(False)).unionByName(X.lone_snippets(self._primary(True)))

    @cached_property
    def segments(self) -> DataFrame:
        return S.segment_table(self.narrow_sessions)

    @cached_property
    def trace(self) -> DataFrame:
        return S.trace_events(self.narrow_sessions)

    @cached_property
    def traced(self) -> DataFrame:
        return self.keep(X.traced_events(self.trace), "traced")

    @cached_property
    def text_places(self) -> DataFrame:
        """Entries with text as hashes of it."""
        return self.keep(X.text_places(X.text_entries(self.with_text(self.traced))), "text_places")

    @cached_property
    def placed(self) -> DataFrame:
        """Events of a segment with the places of the sentences first seen in them, without text."""
        where = self.keep(X.with_texts(self.traced, self.keep(X.text_counts(self.text_places), "texts")), "shown")
        counts = X.sentence_counts(X.entry_sentences(X.text_entries(self.with_text(X.with_others(where)))))
        return self.keep(X.with_places(where, counts), "placed")

    @property
    def firsts(self) -> DataFrame:
        return X.first_sentences(self.with_text(self.placed))

    @cached_property
    def counts(self) -> DataFrame:
        return X.counted_sentences(self.firsts)

    @cached_property
    def common_texts(self) -> DataFrame:
        return X.segment_common_texts(X.first_sentences(self.with_text(X.with_common(self.placed))))

    @cached_property
    def new_texts(self) -> DataFrame:
        return X.segment_new_texts(self.firsts)

    @cached_property
    def new_places(self) -> DataFrame:
        """:attr:`new_texts` without their text."""
        return self.keep(X.new_text_places(self.text_places, self.placed), "new_places")

    @cached_property
    def hours(self) -> DataFrame:
        return H.hourly_active_seconds(self.timed)

    @cached_property
    def hour_common(self) -> DataFrame:
        return H.hour_common_texts(self.new_places, self.common_texts)

    @cached_property
    def clusters(self) -> DataFrame:
        return self.keep(H.hour_clusters(self.new_places, H.interval_by_id(self.timed)), "clusters")

    @cached_property
    def timeline(self) -> DataFrame:
        first = self.keep(H.first_shown(self.new_places, self.clusters), "first_shown")
        told = lambda ties: X.shown_texts(self.with_text(X.with_shown(self.placed, first.filter(ties))))
        return self.keep(H.timeline_of_shown(told("ties = 1"), told("ties > 1")), "timeline")

    @cached_property
    def packs(self) -> DataFrame:
        return self.keep(H.hour_packs(self.hours, self.hour_common, self.clusters, self.timeline), "hour_packs")
