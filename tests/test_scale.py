"""Shapes that keep large tables within bounds."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daymill import session
from daymill.functions import fixed as K
from daymill.functions import text as T
from daymill.llm import warc
from daymill.operators import enrich as M
from daymill.operators import hours as H
from daymill.operators import texts as X
from daymill.operators.context import select_primary_text
from daymill.plans.day import DayJob, _kept
from daymill.sources import logs
from daymill.sources import samples as A
from daymill.streaming import jobs as J

DISPLAYS = "array<struct<display:int,ocr_text:string,excluded:boolean,excluded_reason:string>>"


def shown(spark, texts):
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [("s", t0.date(), i, f"e{i}", t0 + dt.timedelta(seconds=60 * i), 300, "A", 1, [(1, t, False, None)]) for i, t in enumerate(texts)]
    e = spark.createDataFrame(rows, f"source_id string, day date, ingest_seq long, id string, ts timestamp, interval_sec int, active_app string, active_display int, ocr_by_display {DISPLAYS}")
    return e.withColumns({
        "local_ts": F.col("ts").cast("timestamp_ntz"), "tz_offset_sec": F.lit(0), "window_title": F.lit(""), "ocr_text": F.lit(""), "ocr_active_display_text": F.lit(""),
        "browser": F.lit(None).cast("struct<name:string,url:string,domain:string>"), "excluded": F.lit(False), "has_error": F.lit(False)})


def test_stages_hold_no_text_of_entries(spark):
    kept = {}

    def keep(df, name):
        kept[name] = df.columns
        return df

    j = DayJob(shown(spark, ["a. b.", "a. c.", "a."]), keep=keep)
    assert sorted(r["text"] for r in j.counts.collect()) == ["a.", "b.", "c."]
    assert [r["ocr_text"] for r in j.timeline.orderBy("ts").collect()] == ["b.", "c.", "a."]
    wide = {n for n, columns in kept.items() if {"ocr_text", "ocr_by_display", "firsts"} & set(columns)}
    assert wide == {"timeline"}  # its text is asked for


def test_lookup_joins_rows_before_their_text(spark, tmp_path):
    doc = spark.createDataFrame([(0, "x."), (1, "y."), (2, "z.")], "doc_id long, text string")
    ev = spark.createDataFrame([(i, 2 * i, dt.datetime(2024, 1, 1, 10), "view", '{"k": 1}') for i in (1, 2, 5)], "event_id long, user_id long, ts timestamp, event_type string, props string")
    doc.write.parquet(f"{tmp_path}/documents.parquet")
    ev.unionByName(ev.filter("event_id = 5")).write.parquet(f"{tmp_path}/events.parquet")
    at = ["source_id", "day", "ingest_seq"]
    rows = A.events(spark, str(tmp_path)).select(*at, "id")
    text = A.events_with_text(spark, str(tmp_path)).select(*at, *A.TEXT, "active_display")
    want = rows.join(text, at).select("ingest_seq", "id", "active_display", *A.TEXT)
    got = A.text_lookup(spark, str(tmp_path))(rows).select("ingest_seq", "id", "active_display", *A.TEXT)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 6


def test_stages_of_the_day_job_leave_no_shuffle_files(spark):
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    before = held()
    assert _kept(spark.range(1000).repartition(7, "id"), "kept").count() == 1000
    names = {p.name.split("_")[1] for p in held() - before}  # the count has a shuffle of its own
    assert len(names) <= 1
    old = held()
    assert session.staged(spark.range(1000).repartition(7, "id"), "left").select("id").rdd.getNumPartitions() and held() - old


def test_large_files_are_dealt_into_more_parts(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(session, "PART_BYTES", 100)
    assert session.spread(spark.read.parquet(f"{tmp_path}/t"), "id").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_appended_logs_are_compressed(spark, tmp_path):
    lines = spark.createDataFrame([("s", dt.date(2024, 1, 1), i, f"line {i}") for i in range(5)], "source_id string, day date, ingest_seq long, value string")
    logs.append_lines(lines, f"{tmp_path}/log")
    files = [p for p in (tmp_path / "log").rglob("part-*") if "_counts" not in str(p) and not p.name.startswith(".")]
    assert files and all(p.suffix == ".gz" for p in files)
    assert [r["value"] for r in logs.read_lines(spark, f"{tmp_path}/log").orderBy("ingest_seq").collect()] == [f"line {i}" for i in range(5)]


def folders(path):
    """Data files per folder under a table."""
    return Counter(str(p.parent.relative_to(path)) for p in path.rglob("part-*") if not p.name.startswith("."))


def stream_log(spark, tmp_path):
    line = lambda i: json.dumps({"id": "" if i % 10 == 0 else f"e{i % 150}", "ts": f"2024-01-01T{i % 24:02}:{i % 60:02}:00Z", "active_app": f"A{i % 7}"})
    rows = [("st"[i % 2], dt.date(2024, 1, 1 + i % 2), i, line(i)) for i in range(300)]
    logs.append_lines(spark.createDataFrame(rows, "source_id string, day date, ingest_seq long, value string"), f"{tmp_path}/log")
    return f"{tmp_path}/log"


@pytest.fixture
def many_parts(spark):
    """As with large tables, no part is merged into another."""
    new = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_ids_of_a_batch_fill_few_files(spark, tmp_path, many_parts):
    log, out = stream_log(spark, tmp_path), tmp_path / "out"
    J.stream_dedupe(J.stream_events(spark, log), str(out), f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(str(out)).filter("day is not null")
    assert got.count() == 135 + 30 and got.filter("id = ''").count() == 30  # 15 of 150 ids are blank, in 30 of 300 rows
    ids = {k: n for k, n in folders(out).items() if k.startswith("_ids")}
    assert len(ids) > 8 and set(ids.values()) == {1}
    assert all(n <= 16 for k, n in folders(out).items())


def test_refreshed_days_fill_few_files(spark, tmp_path, many_parts):
    log, out = stream_log(spark, tmp_path), tmp_path / "out"
    J.stream_refresh_days(J.stream_events(spark, log), log, str(out), f"{tmp_path}/c").awaitTermination()
    assert folders(out) == {"source_id=s/day=2024-01-01": 1, "source_id=t/day=2024-01-02": 1}


def test_rows_of_a_batch_fill_few_files(spark, tmp_path, many_parts):
    log, out = stream_log(spark, tmp_path), tmp_path / "out"
    J.stream_sessionize(J.stream_lines(spark, log), log, str(out), f"{tmp_path}/c").awaitTermination()
    held = {k: n for k, n in folders(out).items() if k.startswith(("rows", "runs"))}
    assert len(held) == 4 and max(held.values()) <= 24 / J.SLICES_PER_FILE


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(" ",), ('{"id": "a"}',), ('x{"id": "b"} ',), ("[1]",), ("no",)], "value string").repartition(1)
    good, bad = logs.parse_events(lines)
    assert [r["id"] for r in good.collect()] == ["a", "b"] and [r["value"] for r in bad.collect()] == ["[1]", "no"]
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert sum("parsejson" in x.lower().replace("_", "") for x in plan.splitlines()) == 1, plan


def test_words_leave_a_document_once(spark, tmp_path, monkeypatch):
    from daymill.plans.catalog import texts as C

    spark.createDataFrame([(1, "b a  b A", "x"), (2, "a c", "x")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    taken = []
    operator = C.ordered_distinct
    monkeypatch.setattr(C, "ordered_distinct", lambda df, *a: taken.append(df) or operator(df, *a))
    got = C.g4(spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["text"] for r in got] == ["b", "a", "c"] and taken[0].count() == 5


def test_archives_are_read_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BATCH_BYTES", 10)
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (i % 7)) for i in range(50)], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).collect()
    assert sorted(r["page"] for r in got) == list(range(50)) and {r["payload_bytes"] for r in got} == set(range(7))


def test_evidence_of_plain_words_and_concrete_ones(spark):
    tokens = F.array(*map(F.lit, ["plain", "word.", "a.py", "/tmp/x", "2>&1", "~/y", "github.com/z"]))
    got = spark.range(1).select(T.rank_evidence(tokens, 10)).first()[0]
    assert got == "github.com/z / /tmp/x / ~/y / 2>&1 / a.py"


def test_a_lone_text_gives_no_sentence_rows(spark):
    j = DayJob(shown(spark, ["a. b.", "a. b.", "a. b."]), keep=lambda df, name: df)
    where = X.with_texts(j.traced, X.text_counts(j.text_places))
    assert X.entry_sentences(X.text_entries(j.with_text(X.with_others(where)))).count() == 0
    assert j.placed.filter("size(places) > 0").count() == 0
    assert sorted((r["text"], r["entries"]) for r in j.counts.collect()) == [("a.", 3), ("b.", 3)]
    assert [r["ocr_text"] for r in j.new_texts.orderBy("ts").collect()] == ["a.", "a.", "a."]


def test_sentences_of_several_texts_are_weighted_and_events_may_repeat(spark):
    ev = shown(spark, ["a. b.", "a. b.", "a. c.", "d."])
    for rows, times in ((ev, 1), (ev.unionByName(ev), 4)):  # a repeated event meets the text of both its rows
        j = DayJob(rows, keep=lambda df, name: df)
        got = {(r["text"], r["entries"]) for r in j.counts.collect()}
        assert got == {("a.", 3 * times), ("b.", 2 * times), ("c.", times), ("d.", times)}
        places, texts = j.new_places, j.new_texts.drop("ocr_text")
        assert sorted(map(str, places.collect())) == sorted(map(str, texts.select(*places.columns).collect()))


@pytest.mark.parametrize("part_texts", [4096, 1])
def test_an_entry_shuffles_its_sentences_as_one_row_and_gets_them_back_as_bits(spark, monkeypatch, part_texts):
    monkeypatch.setattr(X, "PART_TEXTS", part_texts, raising=False)
    j = DayJob(shown(spark, [" ".join(f"w{i}." for i in range(150)), "w3. w3. new. !? w149.", "a. w64."]))
    rows = X.entry_sentences(X.text_entries(j.with_text(X.with_others(
        X.with_texts(j.traced, X.text_counts(j.text_places)))))).collect()
    assert len(rows) == 3 if part_texts > 1 else len(rows) <= 9  # three texts in at most three parts
    assert len({r["part"] for r in rows}) == (1 if part_texts > 1 else 3) and sum(len(r["h1"]) for r in rows) == 150 + 3 + 2
    twice = {"w3.", "w64.", "w149."}
    assert {(r["text"], r["entries"]) for r in j.counts.collect()} == {
        *((f"w{i}.", 2 if f"w{i}." in twice else 1) for i in range(150)), ("new.", 1), ("a.", 1)}
    assert [(r["rank"], r["text"], r["entries"]) for r in j.common_texts.orderBy("rank").collect()] == [(1, "w3.", 2), (2, "w64.", 2), (3, "w149.", 2)]
    assert [r["ocr_text"] for r in j.new_texts.orderBy("ts").collect()] == [
        " / ".join(f"w{i}." for i in range(150) if f"w{i}." not in twice), "new.", "a."]
    if part_texts > 1:
        assert j.placed.agg(F.sum(F.size("places"))).first()[0] == 8  # 150 sentences in three words, six with those held twice


def test_a_timeline_is_chosen_before_its_text_is_read(spark):
    ev = shown(spark, ["a. b.", "a. c.", "a.", " ", "d. b."]).withColumn("id", F.expr("case when ingest_seq = 4 then 'e0' else id end"))
    for rows in (ev, ev.unionByName(ev.filter("ingest_seq in (0, 2)")), ev.unionByName(ev.filter("ingest_seq = 1").withColumn("id", F.lit("x")))):
        kept = {}
        j = DayJob(rows, keep=lambda df, name: kept.setdefault(name, session.staged(df, name)))  # noqa: B023
        want = H.active_timeline(j.new_texts, j.clusters)
        got = j.timeline
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "ocr_text" not in kept["first_shown"].columns


def test_payloads_and_batches_of_hours_shuffle_their_text_once(spark):
    j = DayJob(shown(spark, ["a. b.", "a. c.", "a."]))
    payload = H.hourly_model_input(j.packs, j.clusters, j.timeline)
    plan = payload._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.index("SortMergeJoin") < plan.index("ObjectHashAggregate")
    c = json.loads(payload.first()["payload"])["clusters"]
    assert [t["ocr_text"] for t in c[0]["active_timeline"]] == ["b.", "c.", "a."] and c[0]["segment_ids"] == [0]
    days = spark.createDataFrame([(s, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, h), "x" * n) for s, h, n in (
        ("s", 0, 9000), ("s", 1, 9000), ("s", 2, 20000), ("t", 0, 5), ("s", 3, 40000), ("s", 4, 1), ("s", 4, 1))], "source_id string, day date, hour_key timestamp_ntz, payload string")
    want = M.make_batches(days, list(H.GROUP), ["hour_key"], "payload", K.HOUR_BATCH_ITEMS, K.HOUR_BATCH_CHARS)
    assert sorted(map(str, M.hour_batches(days, list(H.GROUP)).collect())) == sorted(map(str, want.collect()))


def test_keywords_of_lone_events_equal_those_of_the_aggregate(spark):
    ev = shown(spark, ["see a.py b.py a.py", "run c.sh", "run d.sh c.sh", " ", "e.md"]).withColumn("active_app", F.expr("case when ingest_seq in (1, 2) then 'B' else concat('A', ingest_seq) end")).withColumn(
        "ocr_active_display_excluded", F.lit(False))
    for rows in (ev, ev.unionByName(ev.filter("ingest_seq = 4"))):
        j = DayJob(rows, keep=lambda df, name: df)
        text = select_primary_text(j.sessions)
        for got, want in ((j.keywords, X.segment_keywords(text)), (j.snippets, X.segment_snippets(text))):
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.schema.simpleString() == want.schema.simpleString()
    assert X.with_lone(j.narrow_sessions, j.timed).filter("lone").count() == 2


def test_answers_leave_a_task_in_pieces(spark, monkeypatch):
    from daymill.operators import enrich

    sizes = []
    asked = enrich._asked
    monkeypatch.setattr(enrich, "_asked", lambda frame, keys, fn: sizes.append(len(frame)) or asked(frame, keys, fn))
    taken = {}
    frame = pd.DataFrame({"day": range(250), "batch": 0, "items": [["1", "2"]] * 250})
    fake = type("Batches", (), {"schema": spark.createDataFrame([(1, 0)], "day long, batch long").schema, "select": lambda self, *c: self,
                                "mapInPandas": lambda self, run, schema: taken.update(run=run)})()
    monkeypatch.setattr(enrich, "staged", lambda df, name: df)
    enrich.tagged_output(fake, ["day"], lambda items: [{"n": i} for i in items])
    out = list(taken["run"](iter([frame])))
    assert sizes == [100, 100, 50] and [len(f) for f in out] == [300, 300, 150]


def test_texts_are_not_looked_up_character_by_character(spark):
    odd = "".join(chr(n) for n in K.WS_CODES) + "\x00"
    df = spark.createDataFrame([(f" a{w}\t b.{w}C😀ä{w}",) for w in odd] + [("x• y| Z！ （q）",), (None,)], "t string")
    made = df.select(T.entity_text(F.col("t")).alias("e"), T.collapse(F.col("t")).alias("c"), T.sentence_norm(F.col("t")).alias("n"),
                     T.first_sentence(T.entity_text(F.col("t"))).alias("f"), T.split_sentences(F.col("t")).alias("s"), F.size(T.sentence_keys(T.entity_text(F.col("t")))).alias("k"))
    plan = made._jdf.queryExecution().optimizedPlan().toString().replace("regexp_replace(", "")
    assert "translate(" not in plan and "replace(" not in plan
    rows = made.collect()
    for r in rows[:len(odd) - 1]:
        assert (r["e"], r["c"], r["n"], r["f"], r["s"], r["k"]) == ("a b. C😀ä", "a b. C😀ä", "a b c😀ä", "a b.", ["a b.", "C😀ä"], 2)
    assert (rows[-3]["e"], rows[-3]["c"]) == ("a b. C😀ä", "a\x00 b.\x00C😀ä\x00")
    assert (rows[-2]["s"], rows[-2]["n"], rows[-2]["k"]) == (["x。", "y。", "Z！", "（q）"], "x y z q", 4)
    assert (rows[-1]["e"], rows[-1]["n"], rows[-1]["k"]) == ("", "", 0)


@pytest.mark.parametrize("part_texts", [4096, 1])
def test_keywords_are_shuffled_as_one_row_a_part_and_counted_without_a_sort(spark, monkeypatch, part_texts):
    monkeypatch.setattr(X, "PART_TEXTS", part_texts)
    packed = []
    dealt = X.dealt
    monkeypatch.setattr(X, "dealt", lambda df, *by: packed.append(df) or dealt(df, *by))
    texts = ["beta alpha gamma beta", "zeta alpha delta", " ", "sk-abcdefghijklmnop1 alpha", "w" * 90 + " omega beta", "see a.py b.py", "see b.py", "omega \t zeta"]
    ev = shown(spark, texts).withColumn("ocr_active_display_excluded", F.lit(False)).withColumn("ts", F.expr("case when ingest_seq = 4 then timestamp'2024-01-01 10:00:00' else ts end"))
    j = DayJob(ev, keep=lambda df, name: df)
    assert j.segments.count() == 1
    got = [tuple(r)[3:] for r in j.keywords.orderBy("rank").collect()]
    rows = select_primary_text(j.sessions).orderBy("ts", "ingest_seq").select(F.array_distinct(T.keyword_hits(F.col("primary_text"))).alias("k")).collect()
    n, first = Counter(), {}
    for at, r in enumerate(rows):
        for i, t in enumerate(r["k"]):
            n[t] += 1
            first.setdefault(t, (at, i))
    want = sorted(n, key=lambda t: (-n[t], first[t]))[:8]
    assert got == [(t, n[t], i + 1) for i, t in enumerate(want)] and got[0][:2] == ("alpha", 3) and len(got) == 8 and len(n) > 8
    sent = packed[0].collect()
    assert len(sent) == 7 if part_texts > 1 else len({r["part"] for r in sent}) > 1
    assert "w" * 79 + "…" in n and "sk-…" in n
    plan = j.keywords._jdf.queryExecution().executedPlan().toString()
    assert "token" in plan and not [ln for ln in plan.splitlines() if "SortAggregate" in ln and "token" in ln]
