"""Ordered work that stays whole without putting one group into one task.

``lag`` and running sums over ``(source_id, day)`` would send a source that holds a
third of all rows to a few tasks.  Here a group is cut into time slices; every slice
is a task-sized unit, and only one summary row per slice crosses slice borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymill.session import staged

GROUP = ("source_id", "day")
SLICE_SEC = 900


def time_slice(ts: Column, slice_sec: int = SLICE_SEC) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(slice_sec))


def number_runs(
    df: DataFrame,
    key: Column,
    max_gap_sec: Column,
    out: str = "segment_id",
    group: Sequence[str] = GROUP,
    order: Sequence[str] = ("ts", "ingest_seq"),
    slice_sec: int = SLICE_SEC,
    end: str | None = None,
) -> DataFrame:
    """Number the runs of equal ``key`` in time order, 0-based per group.

    A run ends when the key changes or when ``ts`` moves on by more than
    ``max_gap_sec`` (strictly).  ``order[0]`` is the timestamp; rows that stand for several events have the time
    of the last one in ``end``.  The marked rows are written once and read twice, so ``df`` should be narrow.
    """
    ts = order[0]
    unit = [*group, "_slice"]
    rows = (
        df.withColumn("_key", key)
        .withColumn("_gap", (max_gap_sec * 1000000).cast("long"))
        .withColumn("_us", F.unix_micros(ts)).withColumn("_end", F.unix_micros(end or ts))
        .withColumn("_slice", time_slice(F.col(ts), slice_sec))
    )
    within = Window.partitionBy(*unit).orderBy(*order)
    breaks = ~F.col("_key").eqNullSafe(F.col("_pkey")) | (F.col("_us") - F.col("_pus") > F.col("_gap"))

    # breaks against the previous row of the same slice; a slice head has none
    marked = staged(
        rows.withColumn("_pkey", F.lag("_key").over(within)).withColumn("_pus", F.lag("_end").over(within))
        .withColumn("_brk", F.when(F.col("_pus").isNull(), 0).otherwise(breaks.cast("int")))
        .withColumn("_n", F.sum("_brk").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("_pkey", "_pus"), "runs")
    at = F.struct(*order)
    edge = F.struct("_key", "_us", "_end")
    slices = marked.groupBy(*unit).agg(
        F.min_by(edge, at).alias("_first"), F.max_by(edge, at).alias("_last"),
        F.max("_gap").alias("_gap"), F.sum("_brk").alias("_inner"),
    )
    across = Window.partitionBy(*group).orderBy("_slice")
    head_break = (
        F.col("_prev").isNull()
        | ~F.col("_first._key").eqNullSafe(F.col("_prev._key"))
        | (F.col("_first._us") - F.col("_prev._end") > F.col("_gap"))
    )
    base = (
        slices.withColumn("_prev", F.lag("_last").over(across))
        .withColumn("_starts", head_break.cast("int"))
        .withColumn("_upto", F.sum(F.col("_starts") + F.col("_inner")).over(
            across.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*unit, (F.col("_upto") - F.col("_inner") - 1).alias("_base"))
    )
    return (
        marked.join(base, unit)
        .withColumn(out, (F.col("_base") + F.col("_n")).cast("long"))
        .drop("_key", "_gap", "_us", "_end", "_slice", "_brk", "_n", "_base")
    )


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    value: str,
    tolerance_sec: int,
    ts: str = "ts",
    order: str = "ingest_seq",
) -> DataFrame:
    """Latest ``right.value`` at or before each left row, no older than the tolerance.

    Slices are one tolerance long, so a match lies in the row's own slice or the one
    before it: right rows are sent to both, and no window spans a whole source.
    Adds ``<value>`` and ``<value>_ts``; null where nothing is near enough.
    """
    unit = [*by, "_slice"]
    sl = time_slice(F.col(ts), tolerance_sec)
    lrows = left.withColumn("_slice", sl).withColumn("_isleft", F.lit(1))
    state = F.struct(F.col(ts).alias("at"), F.col(value).alias("v"))
    rrows = right.select(
        *by, F.col(ts), F.col(order), state.alias("_state"), F.lit(0).alias("_isleft"),
        F.explode(F.array(sl, sl + 1)).alias("_slice"),
    )
    both = lrows.unionByName(rrows, allowMissingColumns=True)
    w = Window.partitionBy(*unit).orderBy(ts, "_isleft", order).rowsBetween(Window.unboundedPreceding, 0)
    near = F.col("_hit.at") >= F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(tolerance_sec))
    return (
        both.withColumn("_hit", F.last("_state", ignorenulls=True).over(w))
        .filter(F.col("_isleft") == 1)
        .withColumn(value, F.when(near, F.col("_hit.v")))
        .withColumn(f"{value}_ts", F.when(near, F.col("_hit.at")))
        .drop("_slice", "_isleft", "_state", "_hit")
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group, or all with their rank; a limit is applied before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def ordered_distinct(
    df: DataFrame, by: Sequence[str], text: str, seq: str | Column, limit: int | None = None
) -> DataFrame:
    """Texts per group, whitespace collapsed, case-insensitively distinct, first seen first.

    Output: ``by``, ``rank``, ``text``.  Pre-aggregated by text before any ordering.
    """
    from daymill.functions.text import collapse, without_ws

    pos = F.col(seq) if isinstance(seq, str) else seq
    plain = without_ws(F.col(text)) == F.col(text)  # a word is collapsed already
    first = (
        df.select(*by, pos.alias("_seq"), F.when(plain, F.col(text)).otherwise(collapse(F.col(text))).alias("_t"))
        .filter(F.col("_t") != "")
        .groupBy(*by, F.lower("_t").alias("_low"))
        .agg(F.min_by("_t", "_seq").alias("text"), F.min("_seq").alias("_seq"))
    )
    w = Window.partitionBy(*by).orderBy("_seq")
    ranked = first.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.select(*by, "rank", "text")


def first_seen(df: DataFrame, text: str, seq: Sequence[str], by: Sequence[str] = (), shown: str | None = None) -> DataFrame:
    """How often each text occurs and where first: ``by, text_key, hits, first``.

    ``first`` is a struct of ``seq`` and the text (or the column ``shown``) at its first place.  Rows are grouped by a
    key of fixed size made of two hashes of 128 and 64 bits, so whole texts are no shuffle keys; null texts are left out.
    """
    key = F.concat(F.unhex(F.md5(text)), F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))).alias("text_key")
    first = F.min(F.struct(*seq, F.col(shown or text).alias("text"))).alias("first")
    return df.filter(F.col(text).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("hits"), first)


def distinct_texts(values: Column, limit: int | None = None) -> Column:
    """:func:`ordered_distinct` for a short array inside one row."""
    from daymill.functions.text import collapse, let

    clean = F.filter(F.transform(values, collapse), lambda t: t != "")

    def pick(a: Column) -> Column:
        low = F.transform(a, F.lower)
        kept = let(low, lambda ls: F.filter(a, lambda t, i: F.array_position(ls, F.lower(t)) == i + 1))
        return F.slice(kept, 1, limit) if limit is not None else kept

    return let(clean, pick)


def batch_places(
    df: DataFrame, by: Sequence[str], seq: Sequence[str], size: Column, max_items: int, max_chars: int,
    out: str = "batch",
) -> DataFrame:
    """:func:`pack_batches` without the rows: ``by, seq`` and the batch."""
    from daymill.functions import fixed as K

    cap_items, cap_chars = max(1, max_items), max(K.MIN_BATCH_CHARS, max_chars)
    keyed = df.withColumn("_size", F.greatest(F.lit(2), size).cast("long"))
    sizes = keyed.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.struct(*seq).alias("at"), F.col("_size").alias("size")))).alias("_items")
    )
    zero = F.struct(
        F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"),
        F.array().cast("array<int>").alias("ids"),
    )

    def step(acc: Column, item: Column) -> Column:
        full = (acc["n"] >= cap_items) | (acc["chars"] + item["size"] + 1 > cap_chars)
        fresh = (acc["batch"] < 0) | ((acc["n"] > 0) & full)
        batch = F.when(fresh, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            batch.alias("batch"),
            F.when(fresh, 1).otherwise(acc["n"] + 1).alias("n"),
            (F.when(fresh, F.lit(2).cast("long")).otherwise(acc["chars"]) + item["size"] + 1).alias("chars"),
            F.concat(acc["ids"], F.array(batch)).alias("ids"),
        )

    folded = sizes.select(
        *by, F.arrays_zip(F.col("_items"), F.aggregate("_items", zero, step)["ids"].alias("ids")).alias("_z")
    )
    placed = folded.select(*by, F.explode("_z").alias("_p")).select(
        *by, F.col("_p._items.at").alias("_at"), F.col("_p.ids").alias(out)
    )
    return placed.select(*by, *[F.col(f"_at.{c}").alias(c) for c in seq], out)


def pack_batches(
    df: DataFrame, by: Sequence[str], seq: Sequence[str], size: Column, max_items: int, max_chars: int,
    out: str = "batch",
) -> DataFrame:
    """Greedy sequential packing into batches, 0-based per group.

    A batch closes when it is full or when the next item would push its size (2 for
    the brackets, item size + 1 each) over ``max_chars``.  Packing is a fold over the
    order, so only ``(order, size)`` pairs of one group meet, never payloads; groups
    are days of one source, bounded by the hours of a day.
    """
    return df.join(batch_places(df, by, seq, size, max_items, max_chars, out), [*by, *seq])
