"""Model enrichment as batch jobs.

The model is a plain function over a pandas frame of batches; it runs in
``mapInPandas``, so Spark decides where batches run.  Results are keyed, validated and
merged into what exists, so a job that stops half-way resumes with the missing keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import text as T
from daymill.operators import hours as H
from daymill.operators.filters import eligible_hours
from daymill.operators.ordered import GROUP, batch_places, pack_batches, top_k
from daymill.session import dealt, staged

ModelFn = Callable[[list[dict]], "list[dict] | Reply"]
HOUR = H.HOUR

# ---- fixed values: output shapes of the model stages ------------------------
SHAPES = {
    "segments": "segment_id bigint, task_title string, task_summary string, category string, confidence double",
    "hours": "hour_start_ts string, hour_end_ts string, hour_title string, hour_summary string, confidence double",
    "daily": "daily_title string, daily_summary string, daily_detail string, highlights array<string>, confidence double, evidence array<string>",
    "hour_enrich": "hour_start_ts string, hour_title_enriched string, hour_summary_enriched string",
    "week_clusters": "cluster_id string, canonical_task_name string, item_ids array<string>, confidence double",
    "week_summary": "weekly_title string, weekly_summary string, weekly_detail string, highlights array<string>, confidence double",
}


def make_batches(
    rows: DataFrame, by: Sequence[str], seq: Sequence[str], payload: str, max_items: int, max_chars: int
) -> DataFrame:
    """One row per batch: ``by, batch, items`` (JSON payloads in order)."""
    packed = pack_batches(rows, by, seq, F.length(payload), max_items, max_chars)
    item = F.struct(*seq, F.col(payload).alias("payload"))
    return packed.groupBy(*by, "batch").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["payload"]).alias("items"))


def hour_batches(payload: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`make_batches` of the hours' payloads, shuffled once: a group has few hours, so their batches meet them as one array."""
    places = batch_places(payload, by, ["hour_key"], F.length("payload"), K.HOUR_BATCH_ITEMS, K.HOUR_BATCH_CHARS)
    batches = places.groupBy(*by).agg(F.collect_list(F.struct("hour_key", "batch")).alias("_b"))
    own = F.transform(F.filter("_b", lambda b: b["hour_key"] == F.col("hour_key")), lambda b: b["batch"])
    rows = dealt(payload.select(*by, "hour_key", "payload"), *by).join(dealt(batches, *by), list(by)).select(
        *by, F.explode(own).alias("batch"), F.struct("hour_key", "payload").alias("_item"))
    return rows.groupBy(*by, "batch").agg(F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["payload"]).alias("items"))


@dataclass(frozen=True)
class Reply:
    """What a model function may return instead of plain rows: rows, and the usage of the call."""

    rows: list[dict]
    model: str | None = None
    input_tokens: int = 0
    cached_tokens: int = 0
    output_tokens: int = 0


CALL = "kind string, output string, error string, item string, model string, input_tokens bigint, cached_tokens bigint, output_tokens bigint"


#: Batches whose answers a task holds before it gives them on.
BATCHES_AT_ONCE = 100


def _asked(frame: pd.DataFrame, keys: Sequence[str], model_fn: ModelFn) -> list[tuple]:
    """The rows of :func:`tagged_output` for the batches of one frame."""
    out: list[tuple] = []
    for row in frame.to_dict("records"):
        key = [row[k] for k in keys]
        todo = [list(row["items"])]
        while todo:
            part = todo.pop()
            try:
                got = model_fn([json.loads(x) for x in part])
                reply = got if isinstance(got, Reply) else Reply(got)
                rows = [json.dumps(r, ensure_ascii=False) for r in reply.rows]
            except Exception as e:  # noqa: BLE001 - any model failure is data here
                out.append((*key, "call", None, str(e), None, None, 0, 0, 0))
                if len(part) > 1:
                    mid = len(part) // 2
                    todo += [part[mid:], part[:mid]]
                else:
                    out.append((*key, "error", None, str(e), part[0] if part else None, None, 0, 0, 0))
                continue
            out += [(*key, "answer", r, None, None, None, 0, 0, 0) for r in rows]
            out.append((*key, "call", None, None, None, reply.model, reply.input_tokens, reply.cached_tokens, reply.output_tokens))
    return out


def tagged_output(batches: DataFrame, by: Sequence[str], model_fn: ModelFn) -> DataFrame:
    """``by, batch`` and :data:`CALL`: rows of one pass over the batches, written once.

    ``answer`` rows hold one JSON object each, ``error`` rows the item that a call failed for, and ``call`` rows the usage of a
    call, failed ones too.  A failing batch is halved until single items fail.  A model must not be asked again
    because a plan is read twice.
    """
    keys = [*by, "batch"]
    kinds = {f.name: f.dataType.simpleString() for f in batches.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + CALL
    names = [*keys, "kind", "output", "error", "item", "model", "input_tokens", "cached_tokens", "output_tokens"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCHES_AT_ONCE):
                yield pd.DataFrame(_asked(frame.iloc[at:at + BATCHES_AT_ONCE], keys, model_fn), columns=names)

    return staged(batches.select(*keys, "items").mapInPandas(run, schema), "model_output")


def call_model(batches: DataFrame, by: Sequence[str], model_fn: ModelFn) -> DataFrame:
    """``by, batch, output, error``: one JSON object per result row, or the error of a single item."""
    return tagged_output(batches, by, model_fn).where("kind <> 'call'").select(*by, "batch", "output", "error")


@dataclass(frozen=True)
class ModelPass:
    """The parts of one pass of a model stage.

    ``answers``: rows that fit; ``lost``: what was asked for and has no answer, with the reason;
    ``calls``: usage per call (``stage, by, batch, model``, tokens, ``failed``).
    """

    answers: DataFrame
    lost: DataFrame
    calls: DataFrame


def model_pass(batches: DataFrame, by: Sequence[str], model_fn: ModelFn, shape: str, stage: str) -> ModelPass:
    """Ask once and split the output; ``lost`` holds errors and rejected answers (``by, batch, item, reason``)."""
    tagged = tagged_output(batches, by, model_fn)
    good, rejects = parse_model_output(tagged.where("kind <> 'call'").select(*by, "batch", "output", "error", "item"), shape)
    lost = rejects.select(*by, "batch", F.coalesce("item", "output").alias("item"), F.coalesce("error", "reject_reason").alias("reason"))
    calls = tagged.where("kind = 'call'").select(
        F.lit(stage).alias("stage"), *by, "batch", "model", "input_tokens", "cached_tokens", "output_tokens", F.col("error").isNotNull().alias("failed"))
    return ModelPass(good.drop("item"), lost, calls)


def lost_keys(asked: DataFrame, got: DataFrame, lost: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """``keys, reason`` of everything ``asked`` that is not in ``got``; ``field`` names a JSON field of a lost item, and the asked column, that tells which it is."""
    by = [k for k in keys if k in lost.columns and k != "batch"]
    why = lost.select(*by, F.get_json_object("item", f"$.{field}").alias("_at"), "reason").where("_at is not null").groupBy(*by, "_at").agg(F.min("reason").alias("reason"))
    gone = asked.select(*keys, F.col(field).cast("string").alias("_at")).join(got.select(*keys), list(keys), "left_anti")
    return gone.join(why, [*by, "_at"], "left").select(*keys, F.coalesce("reason", F.lit("no answer")).alias("reason"))


def stage_summary(asked: DataFrame, p: ModelPass, by: Sequence[str] = GROUP) -> DataFrame:
    """Per ``by``: things asked, lost, whether the stage is partial, failed calls and tokens; days without loss too."""
    n = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("asked"))
    lost = p.lost.groupBy(*by).agg(F.count(F.lit(1)).alias("lost"))
    used = p.calls.groupBy(*by).agg(
        F.count_if("failed").alias("failed_calls"), *[F.sum(c).cast("long").alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")])
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("lost", "failed_calls", "input_tokens", "cached_tokens", "output_tokens")}
    return n.join(lost, list(by), "left").join(used, list(by), "left").withColumns(zero).withColumn("partial", F.col("lost") > 0)


def parse_model_output(raw: DataFrame, shape: str, column: str = "output") -> tuple[DataFrame, DataFrame]:
    """Strict reading of model output: (rows that fit, rejects with a reason).

    Text around the JSON object is ignored; every field must be present, of its type
    and in range.
    """
    fields = [tuple(f.strip().split(" ", 1)) for f in SHAPES[shape].split(",")]
    doc = T.labelled_json(F.col(column))
    read = raw.withColumn("_doc", doc).withColumn("_v", F.from_json("_doc", SHAPES[shape]))
    missing = F.lit(False)
    for name, kind in fields:
        col = F.col("_v")[name]
        missing = missing | col.isNull()
        if kind == "double":
            missing = missing | ~F.coalesce(col.between(0, 1), F.lit(False))
    if shape == "segments":
        missing = missing | ~F.coalesce(F.col("_v.category").isin(K.CATEGORIES) & (F.col("_v.segment_id") >= 0), F.lit(False))
    why = F.when(F.col("_doc") == "", "no JSON object").when(
        F.try_parse_json("_doc").isNull(), "not JSON").when(missing, "fields missing or out of range")
    judged = read.withColumn("reject_reason", why)
    good = judged.filter("reject_reason is null")
    plain = [c for c in raw.columns if c not in {n for n, _ in fields} and c != column and c != "error"]
    return (
        good.select(*plain, *[F.col("_v")[n].alias(n) for n, _ in fields]),
        judged.filter("reject_reason is not null").select(*raw.columns, "reject_reason"),
    )


def upsert(existing: DataFrame, fresh: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """Union by key in which the newest version wins."""
    return top_k(existing.unionByName(fresh, allowMissingColumns=True), keys, [F.desc(version)], 1, "_v").drop("_v")


def missing_keys(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(done.select(*keys), list(keys), "left_anti")


# ---- deterministic model -----------------------------------------------------

def rule_hour_model(items: list[dict]) -> list[dict]:
    """Title: first context. Summary: first text on screen, else the first common text."""
    out = []
    for it in items:
        parts = [p.strip() for p in (it["clusters"][0]["segment_key"] if it["clusters"] else []) if p.strip()]
        texts = [t["ocr_text"] for c in it["clusters"] for t in c["active_timeline"] if t["ocr_text"].strip()]
        seen = (texts or it["hour_common_texts"] or [""])[0]
        out.append({
            "hour_start_ts": it["hour_start_ts"], "hour_end_ts": it["hour_end_ts"],
            "hour_title": " / ".join(parts), "hour_summary": _clip_py(seen, 80), "confidence": 0.5})
    return out


def _clip_py(s: str, n: int) -> str:
    s = " ".join(s.split())
    return s if len(s) <= n else s[: n - 1].rstrip() + "…"


def rule_day_model(items: list[dict]) -> list[dict]:
    """Title: first title. Summary: distinct titles in order. Detail: summaries in order."""
    titles = list(dict.fromkeys(i["hour_title"] for i in items if i["hour_title"]))
    notes = [i["hour_summary"] for i in items if i["hour_summary"]]
    return [{
        "daily_title": titles[0] if titles else "", "daily_summary": ", ".join(titles),
        "daily_detail": " ".join(notes), "highlights": titles, "confidence": 0.5, "evidence": notes}]


def rule_enrich_model(items: list[dict]) -> list[dict]:
    return [{
        "hour_start_ts": i["hour_start_ts"], "hour_title_enriched": i["hour_title"],
        "hour_summary_enriched": f"{i['hour_title']} ({i['daily_title']})"} for i in items]


def rule_segment_model(items: list[dict]) -> list[dict]:
    return [{
        "segment_id": i["segment_id"], "task_title": i["label"], "task_summary": f"{i['captures']} captures",
        "category": "other", "confidence": 0.5} for i in items]


# ---- jobs ----------------------------------------------------------------------

def label_hours_pass(
    packs: DataFrame, clusters: DataFrame, timeline: DataFrame, existing: DataFrame | None = None,
    model_fn: ModelFn = rule_hour_model, by: Sequence[str] = GROUP, min_sec: int = K.HOUR_MIN_SEC, max_hours: int | None = None, version: int = 1,
) -> ModelPass:
    """Labels of eligible hours that have none yet; ``lost`` has one row per hour that was sent and got none."""
    wanted = eligible_hours(packs, by, min_sec, max_hours)
    if existing is not None:
        wanted = missing_keys(wanted, existing, HOUR)
    payload = staged(H.hourly_model_input(wanted, clusters, timeline), "hour_payload", clean=True)
    got = model_pass(hour_batches(payload, by), by, model_fn, "hours", "hour")
    keys = wanted.select(*HOUR, "hour_start_ts")
    fresh = got.answers.drop("batch").join(keys, [*by, "hour_start_ts"]).select(
        *HOUR, "hour_title", "hour_summary", "confidence", F.lit(version).cast("long").alias("version"))
    asked = payload.select(*HOUR, F.get_json_object("payload", "$.hour_start_ts").alias("hour_start_ts"))
    return ModelPass(fresh, lost_keys(asked, fresh, got.lost, HOUR, "hour_start_ts"), got.calls)


def label_hours(
    packs: DataFrame, clusters: DataFrame, timeline: DataFrame, existing: DataFrame | None = None,
    model_fn: ModelFn = rule_hour_model, by: Sequence[str] = GROUP, min_sec: int = K.HOUR_MIN_SEC, max_hours: int | None = None, version: int = 1,
) -> DataFrame:
    """Hour labels for eligible hours that have none yet, merged with the existing ones."""
    fresh = label_hours_pass(packs, clusters, timeline, existing, model_fn, by, min_sec, max_hours, version).answers
    return fresh if existing is None else upsert(existing, fresh, HOUR)


def summarize_day_pass(
    inputs: DataFrame, model_fn: ModelFn = rule_day_model, by: Sequence[str] = GROUP, max_chars: int = K.DAY_BATCH_CHARS,
) -> ModelPass:
    """Day summaries by a tree of calls: chunks of hours first, then calls over chunks until one is left per day.

    No call takes more than ``max_chars`` of items: the texts of an item fill a third of that at most.  ``lost`` has the days
    that end without a summary.
    """
    fields = ["hour_key", "hour_start_ts", "hour_end_ts", "active_min_est", "hour_title", "hour_summary"]
    texts = {"hour_title": T.shorten(F.col("hour_title"), max_chars // 12), "hour_summary": T.shorten(F.col("hour_summary"), max_chars // 4)}
    item = F.to_json(F.struct(*fields[1:]))
    level = inputs.select(*by, *fields)
    days, done, calls, lost, items = inputs.select(*by).distinct(), None, None, None, K.DAY_BATCH_ITEMS
    while True:
        rows = staged(level.withColumns(texts).withColumn("payload", item), "day_inputs")
        packed = pack_batches(rows, by, ["hour_key"], F.length("payload"), items, max_chars)
        chunk = staged(packed.groupBy(*by, "batch").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("hour_key", "payload"))), lambda x: x["payload"]).alias("items"),
            F.min("hour_key").alias("hour_key"), F.min_by("hour_start_ts", "hour_key").alias("hour_start_ts"),
            F.max_by("hour_end_ts", "hour_key").alias("hour_end_ts"), F.sum("active_min_est").alias("active_min_est"),
            F.min_by("hour_title", "hour_key").alias("first_title")), "day_chunks")
        got = model_pass(chunk, by, model_fn, "daily", "daily")
        parts = staged(got.answers, "day_parts")
        chunks = chunk.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"))
        last = parts.join(chunks.where("chunks = 1").select(*by), list(by), "left_semi").drop("batch")
        done = last if done is None else done.unionByName(last)
        calls = got.calls if calls is None else calls.unionByName(got.calls)
        lost = got.lost if lost is None else lost.unionByName(got.lost)
        title = F.coalesce(F.nullif(F.trim("daily_title"), F.lit("")), F.col("first_title"))
        summary = F.coalesce(F.nullif(F.trim("daily_summary"), F.lit("")), F.trim("daily_detail"))
        many = parts.join(chunks.where("chunks > 1").select(*by), list(by), "left_semi").join(chunk.drop("items"), [*by, "batch"])
        level = staged(many.select(*by, *fields[:4], title.alias("hour_title"), summary.alias("hour_summary")), "day_level")
        if level.isEmpty():
            break
        items = 1 << 20  # chunks of chunks are bounded by their size alone
    reason = lost.groupBy(*by).agg(F.min("reason").alias("reason"))
    gone = days.join(done.select(*by), list(by), "left_anti").join(reason, list(by), "left").select(*by, F.coalesce("reason", F.lit("no answer")).alias("reason"))
    return ModelPass(done, gone, calls)


def summarize_day(inputs: DataFrame, model_fn: ModelFn = rule_day_model, by: Sequence[str] = GROUP) -> DataFrame:
    """The summaries of :func:`summarize_day_pass`."""
    return summarize_day_pass(inputs, model_fn, by).answers


def enrich_hours_pass(
    overview: DataFrame, daily: DataFrame, existing: DataFrame | None = None,
    model_fn: ModelFn = rule_enrich_model, by: Sequence[str] = GROUP, version: int = 1,
) -> ModelPass:
    """Hours read again in the light of their day; only hours without a result are sent."""
    todo = overview if existing is None else missing_keys(overview, existing, HOUR)
    some = (F.trim("daily_title") != "") | (F.trim("daily_summary") != "")
    rows = todo.join(daily.filter(some).select(*by, "daily_title", "daily_summary"), list(by))
    rows = rows.withColumn("payload", F.to_json(F.struct(
        "hour_start_ts", "hour_end_ts", "hour_title", "hour_summary", "daily_title", "daily_summary")))
    rows = staged(rows, "enrich_payload")
    batches = make_batches(rows, by, ["hour_key"], "payload", K.ENRICH_BATCH_ITEMS, K.ENRICH_BATCH_CHARS)
    got = model_pass(batches, by, model_fn, "hour_enrich", "hour-enrich")
    fresh = got.answers.drop("batch").join(todo.select(*HOUR, "hour_start_ts"), [*by, "hour_start_ts"]).select(
        *HOUR, "hour_title_enriched", "hour_summary_enriched", F.lit(version).cast("long").alias("version"))
    return ModelPass(fresh, lost_keys(rows, fresh, got.lost, HOUR, "hour_start_ts"), got.calls)


def enrich_hours(
    overview: DataFrame, daily: DataFrame, existing: DataFrame | None = None,
    model_fn: ModelFn = rule_enrich_model, by: Sequence[str] = GROUP, version: int = 1,
) -> DataFrame:
    """The results of :func:`enrich_hours_pass`, merged with the existing ones."""
    fresh = enrich_hours_pass(overview, daily, existing, model_fn, by, version).answers
    return fresh if existing is None else upsert(existing, fresh, HOUR)


def label_segments_pass(
    segments: DataFrame, model_fn: ModelFn = rule_segment_model, by: Sequence[str] = GROUP,
    per_day: int | None = None, batch_items: int = 20,
) -> ModelPass:
    """Labels for the segments of every day, or the first ``per_day`` of them; ``lost`` has the segments without one."""
    first = top_k(segments, by, [F.col("segment_id")], per_day, "_n")
    rows = first.withColumn("payload", F.to_json(F.struct("segment_id", "label", "captures", "duration_sec")))
    batches = rows.groupBy(*by, F.floor((F.col("_n") - 1) / batch_items).alias("batch")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "payload"))), lambda x: x["payload"]).alias("items"))
    got = model_pass(batches, by, model_fn, "segments", "segment")
    keys = [*by, "segment_id"]
    return ModelPass(got.answers.drop("batch"), lost_keys(first, got.answers, got.lost, keys, "segment_id"), got.calls)


def label_segments(
    segments: DataFrame, model_fn: ModelFn = rule_segment_model, by: Sequence[str] = GROUP,
    per_day: int | None = None, batch_items: int = 20,
) -> DataFrame:
    """The labels of :func:`label_segments_pass`."""
    return label_segments_pass(segments, model_fn, by, per_day, batch_items).answers


def with_segment_labels(segments: DataFrame, labels: DataFrame, by: Sequence[str] = GROUP, version: str | None = None) -> DataFrame:
    """Segments with their label; blanks and 0.0 where there is none, the later duplicate wins."""
    keys = [*by, "segment_id"]
    one = top_k(labels, keys, [F.desc(version)], 1, "_v").drop("_v") if version else labels
    out = segments.join(one.select(*keys, "task_title", "task_summary", "category", "confidence"), keys, "left")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("task_title", "task_summary", "category")}
    return out.withColumns({**texts, "confidence": F.coalesce("confidence", F.lit(0.0))})


def usage_ledger(calls: DataFrame, prices: DataFrame, tier: str = "standard") -> DataFrame:
    """Usage per stage and model with cost; unpriced calls are counted, not guessed."""
    from daymill.operators.usage import usage_cost

    return usage_cost(calls, prices, tier).groupBy("stage", "model").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("cached_tokens").cast("long").alias("cached_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced"), F.sum("cost_usd").alias("cost_usd"))


