"""Byte-pair encoding by longest matches with backtracking, and decoding by an offset table.

An encoding is the one that merging in rank order gives exactly when no merge crosses the border
of two neighbours before both are complete.  So the encoder takes the longest vocabulary entry at
each place (all entries are found in one Aho-Corasick pass), tests it against its left neighbour
in a table of compatible pairs, and falls back to the next shorter entry or to the place before
when the test fails.  Each place fails once at most, so the work is linear in the text.

Rows: a null or empty text has no ids; repeated rows give repeated results; texts are encoded
whole, whatever their length; an empty table gives an empty table.  Other columns are kept; a
column of the name of a result gives way to it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymill.llm.base import query, slices, table, with_fields

# The published patterns that split text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

#: Stands for the end of a word in vocabularies with an end-of-word suffix; no byte has this code.
WORD_END = "Ā"
#: Results and pair tests kept during a task; beyond that a table starts afresh.
KEEP_WORDS = 120_000
KEEP_PAIRS = 120_000
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, str]:
    """Printable stand-ins of the byte-level alphabet, mapped back to code points 0-255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary file; entries are held as strings of code points 0-255."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, plain = spec["model"], byte_alphabet()
        suffix = model.get("end_of_word_suffix") or ""

        def inner(token: str) -> str:
            ends = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            return "".join(plain[c] for c in body) + (WORD_END if ends else "")

        ids = {inner(t): i for t, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(inner(a), inner(b)) for a, b in merges]
        made = [a + b for a, b in merges]
        merged = set(made)
        order = [t for t in sorted(ids, key=ids.get) if t not in merged] + made
        first = len(order) - len(made)
        self.rank = {t: r for r, t in enumerate(order)}
        if len(self.rank) != len(order) or len(order) != len(ids):
            raise ValueError("every entry must come from one merge or none")
        self.end = WORD_END if suffix else ""
        self.id_bytes = [ids[t].to_bytes(4, "little") for t in order]
        self.length = [len(t) for t in order]
        self.left, self.right = [-1] * first, [-1] * first
        self.merge: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges, first):
            pair = self.rank[a], self.rank[b]
            self.left.append(pair[0])
            self.right.append(pair[1])
            self.merge[pair] = r
        self.matches = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.matches.add_word(t, (r, len(t) - 1))
        self.matches.make_automaton()
        self.shorter = [-1] * len(order)
        for r, t in enumerate(order):
            for n in range(len(t) - 1, 0, -1):
                if (s := self.rank.get(t[:n])) is not None:
                    self.shorter[r] = s
                    break
        self.pairs: dict[int, bool] = {}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def compatible(self, a: int, b: int) -> bool:
        """No merge crosses the border between entries ``a`` and ``b`` before both are complete."""
        xs, ys = [a], [b]
        while (x := self.right[xs[-1]]) >= 0:
            xs.append(x)
        while (y := self.left[ys[-1]]) >= 0:
            ys.append(y)
        while True:
            x, y = xs.pop(), ys.pop()
            next_x, next_y = xs[-1] if xs else _NEVER, ys[-1] if ys else _NEVER
            across = self.merge.get((x, y), _NEVER)
            if across < next_x and across <= next_y and across < _NEVER:
                return False
            if next_x == next_y == _NEVER:
                return True
            if next_x <= next_y:  # at equal ranks the merge further left goes first
                ys.append(y)
            else:
                xs.append(x)

    def ranks(self, word: str) -> list[int]:
        """The entries of one pre-token, given as code points 0-255 (and the end mark)."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(word), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for end, (r, back) in self.matches.iter(word):
            longest[end - back] = r  # the ends come in order, so the longest stays
        out: list[int] = []
        dead: set[int] = set()
        place, r = 0, longest[0]
        while True:
            while r >= 0:
                if place + length[r] not in dead:
                    if not out:
                        break
                    key = out[-1] << 32 | r
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= KEEP_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(out[-1], r)
                    if fits:
                        break
                r = shorter[r]
            if r >= 0:
                out.append(r)
                place += length[r]
                if place == n:
                    return out
                r = longest[place]
            else:
                dead.add(place)
                r = out.pop()
                place -= length[r]
                r = shorter[r]

    def word(self, text: str) -> str:
        return (text if text.isascii() else text.encode().decode("latin-1")) + self.end


class Offsets:
    """The bytes of all entries of a vocabulary file, joined, and where each id's begin."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain, suffix = byte_alphabet(), spec["model"].get("end_of_word_suffix") or ""
        by_id = {}
        for t, i in spec["model"]["vocab"].items():
            ends = bool(suffix) and t.endswith(suffix)
            by_id[i] = "".join(plain[c] for c in (t[: -len(suffix)] if ends else t)).encode("latin-1") + b" " * ends
        by_id |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.blob = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``, gathered at the places that the offset table gives."""
        starts = self.starts[ids]
        sizes = self.starts[ids + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)].tobytes()


class _Pieces(dict):
    """Pre-token to its ids as bytes; filled when asked, of bounded size."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEEP_WORDS:
            self.clear()
        v = self.vocabulary
        ids = self[piece] = b"".join([v.id_bytes[r] for r in v.ranks(v.word(piece))])
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def offsets(path: str) -> Offsets:
    return Offsets(path)


def special_splitter(specials):
    """Cuts a text at special strings, which stay in the result at odd places."""
    import re

    if not specials:
        return lambda text: [text]
    first = [next(iter(specials))[:1]] if len({s[:1] for s in specials}) == 1 else []
    at = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
    return lambda text: [text] if first and first[0] not in text else at.split(text)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """Add the token ids of ``text`` (little-endian unsigned 32-bit, as binary) and their number.

    ``path`` names a byte-level BPE file that every executor can read.  Special strings inside a
    text become their own ids, none is added.  One pass, no shuffle.
    """
    schema = with_fields(docs, **{ids: T.BinaryType(), count: T.LongType()})
    return docs.mapInArrow(_encoder(path, text, ids, count, schema.names[:-2]), schema)


def _encoder(path: str, text: str, ids: str, count: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        v = vocabulary(path)
        pieces = _Pieces(v)
        split, find, of = special_splitter(v.specials), regex.compile(BYTE_PATTERN).findall, pieces.__getitem__
        special = {s: np.array([i], "<u4").tobytes() for s, i in v.specials.items()}
        for b in slices(batches, text, 4 << 20):
            out = []
            for t in b.column(text).to_pylist():
                parts = split(t or "")
                if len(parts) == 1:
                    out.append(b"".join(map(of, find(parts[0]))))
                else:
                    out.append(b"".join(
                        special[p] if k % 2 else b"".join(map(of, find(p))) for k, p in enumerate(parts)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())],
                names=[*kept, ids, count])
        v.pairs.clear()  # idle workers keep the vocabulary only

    return run


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of ``ids``, special strings included; a null in ``ids`` gives an empty text."""
    schema = with_fields(docs, **{text: T.StringType()})
    return docs.mapInArrow(_decoder(path, ids, text, schema.names[:-1]), schema)


def _decoder(path: str, ids: str, text: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = offsets(path)
        for b in slices(batches, ids, 4 << 20):
            out = [entries.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, text])

    return run


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids``, ``n_tokens`` and ``decoded`` of each row: :func:`encode` and :func:`decode` in one Python pass."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    there, back = _encoder(path, "text", "ids", "n_tokens", ["key"]), _decoder(path, "ids", "decoded", ["key", "ids", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in back(there(batches)):
            yield pa.RecordBatch.from_arrays(b.columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(trips: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens`` and the hashes of the ids and of the decoded text."""
    return trips.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op6_bpe_codec")
def op6_bpe_codec(spark, sf):
    import public_tokenizers

    return digests(round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
