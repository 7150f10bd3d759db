"""Token counts of documents without their ids.

Documents are cut into pre-tokens; a block of documents gives one row per distinct pre-token with
the documents that hold it and how often.  These rows meet by pre-token, so each distinct
pre-token is encoded once and its number of pieces joins all its frequencies; the products are
summed per document.  Pre-tokens that are vocabulary entries themselves are one token and are
added up in the first pass.

Pre-tokens travel packed by hash bucket.  Hot pre-tokens: a block sends one entry list per pre-token
at most, and one held by many of its documents goes to one of ``SALTS`` buckets (it is then encoded
that many times at most).

Rows: null or empty texts count 0 tokens; each input row gives a row, repeated rows and repeated
or null keys included; an empty table gives an empty table; extra columns are left out.  Rows of a
partition must come in a stable order, as a table's do: a lost task is run again.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymill.llm.base import query, slices, table
from daymill.llm.bpe import WORD_PATTERN, special_splitter, vocabulary

#: A block ends at so many bytes of text or documents; documents of a block have 16-bit numbers.
BLOCK_BYTES, BLOCK_DOCS = 24 << 20, 1 << 15
#: Pre-tokens in more than a sixteenth of a block's documents go to one of so many places.
SALTS, HOT_SHARE = 64, 16
#: Pre-token counts kept in a task, and blocks whose sums are open at a time.
KEEP_WORDS, OPEN_BLOCKS = 250_000, 4


def normalise(text: str) -> str:
    """Canonical composition and lower case, character by character."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Block:
    """Pre-token frequencies of some documents."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.pieces: list[np.ndarray] = []
        self.keys, self.sizes, self.known, self.bytes = [], [], [], 0

    def add(self, key, text: str, words: list[str], specials: int) -> None:
        places = self.places
        self.pieces.append(np.array([places.setdefault(w, len(places)) for w in words], np.int64))
        n = len(text) if text.isascii() else len(text.encode())
        self.keys.append(key)
        self.sizes.append(n)
        self.known.append(specials)
        self.bytes += n

    def rows(self, block: int, vocabulary, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        n = len(self.keys)
        doc = np.repeat(np.arange(n), [len(p) for p in self.pieces])
        piece = np.concatenate(self.pieces) if self.pieces else np.zeros(0, np.int64)
        words = np.array(list(self.places), object)
        whole = np.array([vocabulary.word(w) in vocabulary.rank for w in self.places], bool)
        if len(words):
            known = np.bincount(doc[whole[piece]], minlength=n) + np.array(self.known)
            rest = ~whole[piece]
            code, times = np.unique(piece[rest] << 16 | doc[rest], return_counts=True)
        else:
            known, code, times = np.array(self.known, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        again = (times + 254) // 255  # a byte holds a frequency; larger ones take several entries
        code = np.repeat(code, again)
        if len(code) > len(times):
            last = np.cumsum(again) - 1
            rest_times = times - (again - 1) * 255
            times = np.full(len(code), 255)
            times[last] = rest_times
        piece, doc = code >> 16, (code & 0xFFFF).astype("<u2")
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        held = np.diff(starts, append=len(piece))  # entries of each pre-token
        sought = words[piece[starts]].tolist()
        salt = np.where(held * HOT_SHARE > n, block * 0x9E3779B1 % SALTS, 0)
        bucket = (np.array([zlib.crc32(w.encode()) for w in sought], np.int64) + salt) % buckets
        yield pa.RecordBatch.from_pydict({
            "block": [block], "bucket": [block], "pieces": [None], "held": [None], "docs": [b""], "times": [b""],
            "keys": [self.keys], "sizes": [self.sizes], "known": [known.tolist()]}, schema)
        order = np.argsort(bucket, kind="stable")
        entry = np.repeat(starts[order], held[order]) + _ramp(held[order])
        doc, times, held = doc[entry], times[entry].astype(np.uint8), held[order]
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
        ends = np.concatenate([[0], np.cumsum(held)])
        for i, j in zip(cuts, cuts[1:]):
            yield pa.RecordBatch.from_pydict({
                "block": [block], "bucket": [int(bucket[order[i]])], "pieces": [" ".join([sought[k] for k in order[i:j]])],
                "held": [held[i:j].astype("<u4").tobytes()], "docs": [doc[ends[i]:ends[j]].tobytes()], "times": [times[ends[i]:ends[j]].tobytes()],
                "keys": [None], "sizes": [None], "known": [None]}, schema)


def frequencies(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """Per block: a row with its documents, and a row per bucket of pre-tokens to be looked up.

    Pre-tokens have no white space, so a blank parts them; ``held`` has each one's number of entries.
    """
    kind = docs.schema[key].dataType
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("pieces", T.StringType()),
        T.StructField("held", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("keys", T.ArrayType(kind)),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("known", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        v = vocabulary(path)
        split, find = special_splitter(v.specials), regex.compile(WORD_PATTERN).findall
        number, block, out = TaskContext.get().partitionId() << 24, _Block(), None
        for b in slices(batches, "text"):
            out = out or pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("pieces", pa.string()), ("held", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()),
                                    ("keys", pa.list_(b.schema.field("key").type)), ("sizes", pa.list_(pa.int64())), ("known", pa.list_(pa.int64()))])
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = t or ""
                parts = split(t)
                words = find(normalise(parts[0]))
                for p in parts[2::2]:
                    words += find(normalise(p))
                block.add(k, t, words, len(parts) // 2)
                if block.bytes >= BLOCK_BYTES or len(block.keys) >= BLOCK_DOCS:
                    yield from block.rows(number, v, buckets, out)
                    number, block = number + 1, _Block()
        if block.keys:
            yield from block.rows(number, v, buckets, out)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row, for a vocabulary with word ends."""
    rows = frequencies(docs, path, key, text)
    sums = T.StructType([f for f in rows.schema if f.name not in ("bucket", "pieces", "held")])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, pieces, held = vocabulary(path), {}, {}

        def close(block: int, schema: pa.Schema) -> pa.RecordBatch:
            total = held.pop(block)
            docs = np.flatnonzero(total)
            return pa.RecordBatch.from_pydict({
                "block": [block], "docs": [docs.astype("<u2").tobytes()], "times": [total[docs].astype("<u4").tobytes()],
                "keys": [None], "sizes": [None], "known": [None]}, schema)

        out = None
        for b in batches:
            if not b.num_rows:
                continue
            out = out or pa.schema([b.schema.field(n) for n in ("block", "docs", "times", "keys", "sizes", "known")])
            for block, words, sizes, docs, times in zip(*(b.column(n).to_pylist() for n in ("block", "pieces", "held", "docs", "times")), strict=True):
                if words is None:
                    continue
                counts = []
                for w in words.split(" "):
                    n = pieces.get(w)
                    if n is None:
                        if len(pieces) >= KEEP_WORDS:
                            pieces.clear()
                        n = pieces[w] = len(v.ranks(v.word(w)))
                    counts.append(n)
                if block not in held:
                    while len(held) >= OPEN_BLOCKS:
                        yield close(next(iter(held)), out)
                    held[block] = np.zeros(BLOCK_DOCS, np.int64)
                product = np.repeat(counts, np.frombuffer(sizes, "<u4")) * np.frombuffer(times, np.uint8)
                held[block] += np.bincount(np.frombuffer(docs, "<u2"), product, BLOCK_DOCS).astype(np.int64)
            heads = pa.compute.indices_nonzero(b.column("pieces").is_null())
            if len(heads):
                yield pa.RecordBatch.from_arrays([b.column(n).take(heads) for n in out.names], schema=out)
        for block in list(held):
            yield close(block, out)
        v.pairs.clear()  # idle workers keep the vocabulary only

    def total(t: pa.Table) -> pa.Table:
        head = t.filter(t["keys"].is_valid())
        n = len(head["sizes"][0])
        tokens = np.array(head["known"][0].as_py(), np.int64)
        for docs, times in zip(t["docs"].to_pylist(), t["times"].to_pylist(), strict=True):
            at = np.frombuffer(docs, "<u2")
            tokens += np.bincount(at, np.frombuffer(times, "<u4"), n).astype(np.int64)
        return pa.table({key: head["keys"].combine_chunks().flatten(), "n_bytes": head["sizes"].combine_chunks().flatten(), "n_tokens": tokens})

    result = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.repartition("bucket").mapInArrow(price, sums).groupBy("block").applyInArrow(total, result)


@query("op5_token_counts")
def op5_token_counts(spark, sf):
    import public_tokenizers

    counts = count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
