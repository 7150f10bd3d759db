"""Packing of token sequences by minimum bin slack.

A document gives as many whole windows of ``capacity`` tokens as it has, and one remaining length.  Only
the number of documents per remaining length decides the rest, so Spark counts them (at most ``capacity`` - 1
rows) and the driver plans over this multiset: each window starts with the longest length left, a bitset of reachable
sums (one bit a sum, one shift a power of two of copies) finds the filling closest to the capacity, and going back through
the bitsets gives the count of each length.  A filling repeats as often as its lengths last.  Where the best
filling leaves slack, one more length is cut to close it and its rest goes back into the
multiset; so at most one window of the whole result is not full, also where copies give a single length.

Documents get their places from ranks within their length: a running number within hash buckets plus the
sums of the buckets before.  Buckets are cut from ids, not from lengths, so a length that a third of all documents
have is spread like any other.  The plan has at most a few thousand lines, whatever the input.

Rows: each row is one document, also where keys are null or repeat; a null or empty ``ids`` has no piece; documents of any
length are cut into windows; which of several equal lengths goes where follows from the written rows; an
empty table gives an empty table.  Other columns do not matter; a result whose name the key has gets
an underscore in front.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymill.llm.base import query, slices, table
from daymill.llm.bpe import BYTE_PATTERN, byte_alphabet
from daymill.session import staged, work_folder

#: Rows of one bucket at most, about; a bucket is numbered in one task.
BUCKET_ROWS = 250_000
_RANKS = 46  # bits of a rank beside a length


# ---- planning ------------------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    """Lines of the plan, sorted by length and first rank.

    Ranks from ``first`` on go, ``times`` a window, into window ``window`` and those after it, at ``offset``; where ``head``
    is set the piece is cut there and the rest continues as rank ``rest`` of its own length.
    """

    key: np.ndarray
    times: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    head: np.ndarray
    rest: np.ndarray
    windows: int


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often, with the largest sum of at most ``room``, out of ``counts``."""
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    within = (1 << room + 1) - 1
    reach = [1]
    for n in lengths:
        sums, left, step = reach[-1], min(counts[n], room // n), 1
        while left:
            step = min(step, left)
            sums |= sums << step * n
            left, step = left - step, 2 * step
        reach.append(sums & within)
        if sums >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    out = {}
    for i in range(len(reach) - 2, -1, -1):
        n, k = lengths[i], 0
        while not reach[i] >> at & 1:
            at, k = at - n, k + 1
        if k:
            out[n] = k
    return out


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Place every length of the multiset ``counts``."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(range(1, capacity), 0)
    lines: list[tuple] = []
    windows = 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        need = fill(rest, capacity - longest)
        need[longest] = need.get(longest, 0) + 1
        slack = capacity - sum(n * k for n, k in need.items())
        more = [n for n in left if left[n] > need.get(n, 0)] if slack else []
        cut = max(more, default=0)
        asked = need | ({cut: need.get(cut, 0) + 1} if cut else {})
        times = min(left[n] // k for n, k in asked.items())
        offset = 0
        for n in sorted(need, reverse=True):
            lines.append((n << _RANKS | used[n], need[n], windows, offset, 0, 0))
            used[n] += times * need[n]
            left[n] -= times * need[n]
            offset += n * need[n]
        if cut:
            over = cut - slack
            lines.append((cut << _RANKS | used[cut], 1, windows, offset, slack, used[over] + left.get(over, 0)))
            used[cut] += times
            left[cut] -= times
            left[over] = left.get(over, 0) + times
        windows += times
        left = {n: c for n, c in left.items() if c}
    columns = np.array(sorted(lines), np.int64).reshape(-1, 6).T
    return Plan(*columns, windows)


def place(p: Plan, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(index, start, length, window, offset) of the pieces of remaining lengths, cut by cut."""
    index, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    while len(index):
        line = np.searchsorted(p.key, length << _RANKS | rank, "right") - 1
        nth = rank - (p.key[line] & (1 << _RANKS) - 1)
        head = p.head[line]
        size = np.where(head > 0, head, length)
        yield index, start, size, p.window[line] + nth // p.times[line], p.offset[line] + nth % p.times[line] * length
        on = head > 0
        index, start, rank = index[on], (start + size)[on], (p.rest[line] + nth)[on]
        length = (length - size)[on]


# ---- token ids -------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _encoding(path: str):
    """The merges of a byte-level BPE file in tiktoken, which takes the order of ids as the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain, vocab = byte_alphabet(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(set(made)):
        raise ValueError("ids must come in the order of merges")
    ranks = {"".join(plain[c] for c in t).encode("latin-1"): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("file", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = 0) -> DataFrame:
    """``key`` and ``ids`` of every row: the ids of its text as little-endian unsigned 32-bit, then ``end``."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType())])
    last = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_to_numpy
        for b in slices(batches, "text", 4 << 20):
            out = [encode(t, allowed_special="all").astype("<u4", copy=False).tobytes() + last if t else last for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], names=schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


# ---- packing ----------------------------------------------------------------------------

def _ranked(rows: DataFrame, capacity: int) -> DataFrame:
    """Rows (row, n) with ``rank`` among equal remaining lengths and ``before``, the whole windows of the rows before."""
    conf = rows.sparkSession.conf
    buckets = max(int(conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
    at = rows.select("row", "n", (F.col("n") % capacity).alias("length"), F.floor(F.col("n") / capacity).alias("full"),
                     F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))
    sums = staged(at.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f")), "lengths")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranks = sums.select("bucket", "length", F.coalesce(F.sum("c").over(earlier(Window.partitionBy("length").orderBy("bucket"))), F.lit(0)).alias("r0"))
    whole = sums.groupBy("bucket").agg(F.sum("f").alias("f"))  # one row a bucket, so one task may number them
    whole = whole.select("bucket", F.coalesce(F.sum("f").over(earlier(Window.orderBy("bucket"))), F.lit(0)).alias("f0"))
    in_bucket = Window.partitionBy("bucket").orderBy("row")
    numbered = at.withColumns({
        "i": F.row_number().over(Window.partitionBy("bucket", "length").orderBy("row")) - 1,
        "w": F.coalesce(F.sum("full").over(earlier(in_bucket)), F.lit(0))})
    return numbered.join(ranks, ["bucket", "length"]).join(whole, "bucket").select(
        "row", "n", (F.col("r0") + F.col("i")).alias("rank"), (F.col("f0") + F.col("w")).alias("before"))


PIECES = "row bigint, start bigint, length bigint, sequence_id bigint, offset bigint"


def _pieces(ranked: DataFrame, p: Plan, whole: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n, rank, before = (b.column(c).to_numpy() for c in ("row", "n", "rank", "before"))
            full = n // capacity
            of = np.repeat(np.arange(len(row)), full)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
            parts = [(of, nth * capacity, np.full(len(of), capacity), before[of] + nth, np.zeros(len(of), np.int64))]
            some = np.flatnonzero(n % capacity)
            for i, start, length, window, offset in place(p, (n % capacity)[some], rank[some]):
                i = some[i]
                parts.append((i, full[i] * capacity + start, length, whole + window, offset))
            i, *rest = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (row[i], *rest)], names=["row", "start", "length", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES)


def pack(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", capacity: int = 1024) -> DataFrame:
    """Pieces: ``key``, ``start``, ``length``, ``ids`` (of the piece), ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``ids`` of ``tokens`` are little-endian unsigned 32-bit numbers as binary.  Sequences that hold one
    document's whole window come first; every sequence but one is full.
    """
    n = F.coalesce(F.octet_length(F.col(f"`{ids}`")), F.lit(0)).cast("long") / 4
    rows = tokens.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), n.cast("long").alias("n"), F.col(f"`{ids}`").alias("ids"))
    path = work_folder(tokens.sparkSession, "token-ids")
    rows.write.option("compression", "zstd").parquet(path)  # ids take two of their four bytes
    rows = tokens.sparkSession.read.schema(rows.schema).parquet(path)
    narrow = rows.where("n > 0").select("row", "n")
    length, full = F.col("n") % capacity, F.floor(F.col("n") / capacity)
    counts = narrow.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("c"), F.sum(full).alias("f")).collect()
    p = plan({r["length"]: r["c"] for r in counts if r["length"]}, capacity)
    pieces = _pieces(_ranked(narrow, capacity), p, sum(r["f"] for r in counts), capacity)
    out = {
        "start": F.col("start"), "length": F.col("length"),
        "ids": F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")),
        "doc_tokens": F.col("n"), "sequence_id": F.col("sequence_id"), "offset": F.col("offset")}
    return rows.join(pieces, "row").select(F.col("key").alias(key), *(c.alias(name if name != key.lower() else "_" + name) for name, c in out.items()))


@query("op11_slack_packing")
def op11_slack_packing(spark, sf):
    import public_tokenizers

    tokens = token_ids(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(tokens).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
