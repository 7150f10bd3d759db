"""Text expressions: whitespace, entities, sentences, normal forms and scores.

All of these stay on the JVM.  ``let`` binds an expression to a lambda variable so
that it is evaluated once per row even when the body uses it inside another lambda.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from daymill.functions import fixed as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def one_of(chars: Iterable[str]) -> str:
    """Pattern of one of ``chars``.

    Those of Latin-1 are one table look-up; the others are compared only within their range, so other text is passed over
    fast.  ``translate`` looks each character of a text up in a map and is several times slower.
    """
    codes = sorted(map(ord, chars))
    near, far = [n for n in codes if n < 256], [n for n in codes if n >= 256]
    written = lambda a: "".join(rf"\x{{{n:x}}}" for n in a)
    return f"[{written(near)}" + (rf"[[\x{{{far[0]:x}}}-\x{{{far[-1]:x}}}]&&[{written(far)}]]" if far else "") + "]"


_WS_CHARS = "".join(chr(n) for n in K.WS_CODES)
_WS_ONE, _WS_MARK = one_of(_WS_CHARS), one_of(_WS_CHARS.replace(" ", ""))
_WS_OR_NUL = one_of(_WS_CHARS.replace(" ", "\x00"))


def without_ws(c: Column) -> Column:
    """Whitespace removed."""
    return F.regexp_replace(c, _WS_ONE, "")


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space, ends are trimmed; null becomes ''."""
    return _one_spaced(F.regexp_replace(text_of(c), _WS_MARK, " "))


def _one_spaced(spaced: Column) -> Column:
    return let(
        spaced,
        lambda t: F.trim(F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)),
    )


def _clip(s: Column, limit: int) -> Column:
    head = F.rtrim(F.substring(s, 1, limit - 1))
    return F.when(F.length(s) > limit, F.concat(head, F.lit("…"))).otherwise(s)


def shorten(c: Column, limit: int = K.TITLE_CHARS) -> Column:
    return let(collapse(c), lambda s: _clip(s, limit))


def redact_derived(c: Column) -> Column:
    """Mask keys and addresses in text that was derived from screens."""
    keys = replace_where(text_of(c), lambda t: t.contains("sk-"), K.DERIVED_KEY, K.DERIVED_KEY_TAG)
    return replace_where(keys, lambda t: t.contains("@"), K.EMAIL, K.EMAIL_TAG)


def replace_where(c: Column, worth: Callable[[Column], Column], pattern: str, tag: str) -> Column:
    """Replace by pattern only in texts that pass a cheap necessary condition."""
    return let(c, lambda t: F.when(worth(t), F.regexp_replace(t, pattern, tag)).otherwise(t))


def shorten_token(c: Column, limit: int = 80) -> Column:
    return let(redact_derived(collapse(c)), lambda s: _clip(s, limit))


def shorten_path(c: Column, limit: int = 80) -> Column:
    home = F.regexp_replace(redact_derived(c), "^/Users/[^/]+/", "~/")
    return let(
        home,
        lambda s: F.when(
            F.length(s) > limit, F.concat(F.lit("…"), F.substring(s, -(limit - 1), limit - 1))
        ).otherwise(s),
    )


def _fix_dev_slash(c: Column) -> Column:
    return let(c, lambda t: F.when(t.contains("DEV"), F.regexp_replace(t, K.DEV_SLASH, "DEV/")).otherwise(t))


def _no_nul(c: Column) -> Column:
    return F.replace(text_of(c), F.lit("\x00"), F.lit(" "))


def entity_text(c: Column) -> Column:
    """One-line form used for entity extraction; a NUL counts as whitespace."""
    return _fix_dev_slash(_one_spaced(F.regexp_replace(text_of(c), _WS_OR_NUL, " ")))


# ---- guards -----------------------------------------------------------------

def folded(c: Column) -> Column:
    """Case-folded so that whatever a case-blind pattern takes for a letter reads as it."""
    return F.replace(F.lower(F.upper(c)), F.lit("\u0307"), F.lit(""))


def has_any(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def find_all(t: Column, pattern: str, group: int, worth: Column) -> Column:
    """All matches, looked for only where a cheap necessary condition holds."""
    return F.when(worth, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def matches(t: Column, pattern: str, worth: Column) -> Column:
    return F.when(worth, t.rlike(pattern)).otherwise(F.lit(False))


# ---- entities ---------------------------------------------------------------

def _trim_anchors(raw: Column) -> Column:
    """Cut to the first known host that occurs past the start, then to a known end."""
    cut = raw
    for anchor in reversed(K.URL_ANCHORS):
        at = F.instr(raw, anchor)
        cut = F.when(at > 1, raw.substr(at, F.length(raw))).otherwise(cut)
    host, end = K.API_KEYS_ANCHOR
    return let(
        cut,
        lambda s: F.when(
            s.contains(host) & s.contains(end),
            s.substr(F.lit(1), F.instr(s, end) + F.lit(len(end) - 1)),
        ).otherwise(s),
    )


def _host_and_path(s: Column) -> Column:
    """``scheme://host/path?query`` becomes ``host/path``; anything else is kept."""
    host = F.regexp_extract(s, r"(?i)^https?://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(s, r"(?i)^https?://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    plain = s.rlike("(?i)^https?://") & (host != "") & ~host.rlike(r"[\[\]]")
    return F.when(plain, F.concat(host, path)).otherwise(s)


def extract_urls(flat: Column) -> Column:
    """Distinct URLs and bare domains of an :func:`entity_text`, as host + path."""

    def find(t: Column) -> Column:
        urls = find_all(t, K.URL, 0, t.contains("://"))
        bare = F.filter(
            find_all(t, K.DOMAIN_PATH, 0, t.rlike(K.DOMAIN_END)),
            lambda d: ~t.contains(F.concat(F.lit("/"), d)),
        )
        tidy = F.transform(
            F.concat(urls, bare),
            lambda h: let(
                F.regexp_replace(h, K.URL_TAIL, ""),
                lambda r: let(_trim_anchors(r), _host_and_path),
            ),
        )
        return F.array_distinct(F.filter(tidy, lambda u: u != ""))

    return let(flat, find)


def extract_paths(c: Column, flat: Column | None = None) -> Column:
    """Distinct absolute paths, minus prefixes that a line break cut short.

    ``flat`` is the :func:`entity_text` of ``c`` where the caller has it already.
    """
    joined = _fix_dev_slash(F.replace(_no_nul(c), F.lit("\n"), F.lit("")))
    line = entity_text(c) if flat is None else flat
    hits = F.when(
        c.contains("/"),
        F.concat(
            F.regexp_extract_all(line, F.lit(K.POSIX_PATH), F.lit(1)),
            let(joined, lambda j: F.regexp_extract_all(j, F.lit(K.POSIX_PATH), F.lit(1))),
        ),
    ).otherwise(F.array().cast("array<string>"))

    def drop_truncated(paths: Column) -> Column:
        def keep(p: Column) -> Column:
            tail = F.substring_index(p, "/", -1)
            stub = (F.length(tail) <= 3) | tail.isin(K.TRUNCATED_TAILS)
            longer = F.exists(paths, lambda q: (q != p) & F.startswith(q, p))
            return ~(stub & longer)

        return F.filter(paths, keep)

    return let(F.array_distinct(F.filter(hits, lambda p: p != "")), drop_truncated)


def extract_files(flat: Column) -> Column:
    return let(flat, lambda t: find_all(t, K.FILE_TOKEN, 0, t.rlike(r"\.\S")))


def extract_words(flat: Column) -> Column:
    return F.regexp_extract_all(flat, F.lit(K.WORD), F.lit(0))


def extract_ja_runs(flat: Column) -> Column:
    return F.regexp_extract_all(flat, F.lit(K.JA_RUN), F.lit(0))


def keyword_hits(c: Column) -> Column:
    """Tokens of one text in discovery order; words are used only when nothing else is found."""

    def gather(flat: Column) -> Column:
        markers = F.filter(
            F.array(*[F.lit(m) for m in K.KEYWORD_MARKERS]), lambda m: flat.contains(m)
        )
        strong = F.concat(extract_files(flat), extract_paths(c, flat), extract_urls(flat), markers)
        weak = F.concat(extract_words(flat), extract_ja_runs(flat))
        short = lambda tokens: F.transform(tokens, lambda h: shorten_token(h, 80))
        # a word holds neither whitespace nor an @, so without a key it can only be too long
        words = F.when(flat.contains("sk-"), short(weak)).otherwise(F.transform(weak, lambda h: _clip(h, 80)))
        return let(strong, lambda s: F.when(F.size(s) > 0, short(s)).otherwise(words))

    return let(entity_text(c), gather)


# ---- sentences --------------------------------------------------------------

_BULLET, _SENTENCE_GAP = one_of(K.BULLETS), f" (?<={one_of(K.SENTENCE_ENDS)} )"
_KEY_GAP = f" (?<={one_of(K.SENTENCE_ENDS + K.BULLETS)} )"


def _mark_sentences(flat: Column) -> Column:
    """Sentences of a collapsed text, one per line; a bullet ends a sentence too.

    A collapsed text holds no line break and no double space, so plain replacement works.
    """
    return F.regexp_replace(_without_bullets(flat), _SENTENCE_GAP, "\n")


def _without_bullets(flat: Column) -> Column:
    return replace_where(flat, lambda t: has_any(t, list(K.BULLETS)), _BULLET, "。")


def split_sentences(c: Column) -> Column:
    parts = F.split(_mark_sentences(collapse(c)), "\n")
    return F.filter(parts, lambda p: p != "")


def first_sentence(flat: Column) -> Column:
    """First sentence of a collapsed text, without splitting the rest."""
    return _without_bullets(F.regexp_extract(flat, K.FIRST_SENTENCE, 0))


_MARK = one_of(K.QUOTES + K.PUNCT)


def _strip_marks(low: Column) -> Column:
    return F.regexp_replace(low, _MARK, "")


def sentence_norm(c: Column) -> Column:
    return _strip_marks(F.lower(collapse(c)))


def common_text_norm(c: Column) -> Column:
    return F.replace(sentence_norm(c), F.lit(" "), F.lit(""))


def similarity_norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text_of(c))), K.SIMILARITY_STRIP, "")


def sentence_keys(flat: Column) -> Column:
    """``array<struct<pos,h1,h2>>`` of a collapsed text: where each distinct normal form first stands, in order, and its key.

    The key is two independent hashes of 64 and 32 bits, so it has the same size for every sentence.  Normal forms are made
    for the whole text at once and split along the same marks; sorting and keeping run heads is n log n, and done only where
    a text repeats a sentence.  Normal forms hold no bullets, so these need not be made to ends first.
    """
    return F.sort_array(F.transform(let(F.regexp_replace(flat, _KEY_GAP, "\n"), _marked_keys), lambda k: F.struct(
        k["pos"].alias("pos"), k["h1"].alias("h1"), F.shiftright(k["h2"], 32).cast("int").alias("h2"))))


def _marked_keys(marked: Column) -> Column:
    tags = F.filter(
        F.transform(F.split(_strip_marks(F.lower(marked)), "\n"), lambda n, i: F.struct(
            F.when(n != "", F.xxhash64(n)).alias("h1"), F.xxhash64(F.lit(1), n).alias("h2"), i.alias("pos"))),
        lambda x: x["h1"].isNotNull(),
    )
    heads = lambda a: F.filter(
        a, lambda x, i: (i == 0) | (F.get(a, i - 1)["h1"] != x["h1"]) | (F.get(a, i - 1)["h2"] != x["h2"]))
    apart = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["h1"]))) == F.size(a)
    return let(tags, lambda a: F.when(apart(a), a).otherwise(let(F.sort_array(a), heads)))


def sentences_at(flat: Column, places: Column, every: Column) -> Column:
    """``pos, entries, text`` of sentences of a collapsed text in order: those at ``places`` (``entries`` and ``bits`` of the
    64 positions of a ``word``), or where ``every`` is not null the first of each normal form, with ``every`` as ``entries``.
    """
    place = lambda pos, n: F.struct(pos.alias("pos"), n.alias("entries"))
    wanted = lambda marked: F.when(
        every.isNotNull(), F.transform(_marked_keys(marked), lambda k: place(k["pos"], every))).otherwise(
        F.flatten(F.transform(places, lambda p: F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(p["bits"], b) == 1), lambda b: place(p["word"] * 64 + b, p["entries"])))))
    return let(_mark_sentences(flat), lambda marked: let(F.split(marked, "\n"), lambda parts: F.transform(
        F.sort_array(wanted(marked)), lambda p: F.struct(p["pos"].alias("pos"), p["entries"].alias("entries"), F.get(parts, p["pos"]).alias("text")))))


# ---- scores -----------------------------------------------------------------

def snippet_score(line: Column) -> Column:
    """Worth of one line as a snippet; below zero means noise."""
    p = K.SNIPPET_SCORES

    def points(s: Column) -> Column:
        def add(cond: Column, n: int) -> Column:
            return F.when(cond, F.lit(n)).otherwise(F.lit(0))

        output = s.contains(K.OUTPUT_MARKERS[0])
        for m in K.OUTPUT_MARKERS[1:]:
            output = output | s.contains(m)
        total = (
            add(matches(s, K.URL, s.contains("://")) | matches(s, K.DOMAIN_PATH, s.rlike(r"\.\S")), p["url"])
            + add(matches(s, K.POSIX_PATH, s.contains("/")), p["path"])
            + add(matches(s, K.FILE_TOKEN, s.rlike(r"\.\S")), p["file"])
            + add(output, p["output"])
            + add(s.contains("github.com"), p["repo"])
            + add(s.contains("openai.com"), p["api"])
            + add(s.rlike(K.JA_RUN), p["ja"])
            + add(F.length(s).between(16, 180), p["sized"])
            + add(F.length(s) > 220, p["long"])
        )
        return (
            F.when((s == "") | s.rlike(K.NOISE_LINE), F.lit(p["noise"]))
            .when(s.rlike(K.SHORT_CODE) | s.rlike(K.PLAIN_NUMBER), F.lit(p["short"]))
            .otherwise(total)
        )

    return let(F.trim(text_of(line)), points)


def text_lines(c: Column) -> Column:
    """Non-blank trimmed lines."""
    lines = F.transform(F.split(text_of(c), K.LINE_BREAK), strip_ws)
    return F.filter(lines, lambda ln: ln != "")


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, "^" + K.WS + "+|" + K.WS + "+$", "")


def rank_snippets(c: Column, limit: int = 3, width: int = 120) -> Column:
    """Best snippets of a text: a URL, a path, more of both, then well-scored lines.

    At least one scored line is always taken when there is one; without entities
    and scored lines, the first line that is not noise stands in.
    """

    def pick(urls: Column, paths: Column, lines: Column) -> Column:
        rest = F.concat(F.slice(urls, F.lit(2), F.greatest(F.size(urls), F.lit(1))), F.slice(paths, F.lit(2), F.greatest(F.size(paths), F.lit(1))))
        lead = F.concat(F.slice(urls, 1, 1), F.slice(paths, 1, 1))
        found = F.slice(F.array_distinct(F.filter(F.concat(lead, rest), lambda x: x != "")), 1, limit)
        ranks = F.filter(
            F.transform(lines, lambda ln, i: F.struct((-snippet_score(ln)).alias("rank"), i.alias("pos"), ln.alias("line"))),
            lambda x: x["rank"] <= 0,
        )
        return let(ranks, lambda kept: let(found, lambda e: choose(e, kept)))

    def choose(entities: Column, kept: Column) -> Column:
        """``kept`` has every line that is not noise with its score, so no line is scored twice."""
        texts = F.filter(
            F.transform(kept, lambda x: F.struct(x["rank"], x["pos"], shorten_token(x["line"], width).alias("text"))),
            lambda x: x["text"] != "",
        )

        def finish(worth: Column) -> Column:
            scored = F.sort_array(F.filter(worth, lambda x: x["rank"] < 0))
            ranked = F.array_distinct(F.transform(scored, lambda x: x["text"]))
            fresh = F.filter(ranked, lambda t: ~F.array_contains(entities, t))
            room = F.greatest(F.lit(1), F.lit(limit) - F.size(entities))
            return let(F.concat(entities, F.slice(fresh, F.lit(1), room)), lambda out: F.when(F.size(out) > 0, out).otherwise(
                F.transform(F.slice(worth, 1, 1), lambda x: x["text"])))

        return let(texts, finish)

    def from_flat(flat: Column) -> Column:
        urls = F.transform(extract_urls(flat), lambda u: shorten_token(u, width))
        paths = F.transform(extract_paths(c, flat), lambda p: shorten_path(p, width))
        return let(urls, lambda u: let(paths, lambda p: let(text_lines(c), lambda ls: pick(u, p, ls))))

    return let(entity_text(c), from_flat)


def evidence_score(tok: Column) -> Column:
    def points(t: Column) -> Column:
        total = F.lit(0)
        for marker, n in K.EVIDENCE_CONTAINS:
            total = total + F.when(t.contains(marker), n).otherwise(0)
        anchored = t.startswith("/") | t.startswith("~/") | t.rlike(K.EVIDENCE_HOST_PATH)
        noisy = (F.length(t) - F.length(F.translate(t, "x", "")) >= 6) | (
            F.length(t) - F.length(F.translate(t, "✕", "")) >= 3
        )
        total = (
            total
            + F.when(anchored, 4).otherwise(0)
            + F.when(t.rlike(K.EVIDENCE_EXTENSION), 2).otherwise(0)
            + F.when(t.rlike(K.EVIDENCE_README), 2).otherwise(0)
            - F.when(noisy, 4).otherwise(0)
            - F.when(F.length(t) > 140, 2).otherwise(0)
        )
        return (
            F.when((F.length(t) <= 2) | t.rlike(K.NOISE_LINE), F.lit(-10))
            .when(t.rlike(K.SHORT_CODE), F.lit(-6))
            .otherwise(total)
        )

    return let(F.trim(text_of(tok)), points)


def rank_evidence(tokens: Column, limit: int = 3) -> Column:
    """Concrete tokens, best first, joined by `` / ``."""

    def tidy(t: Column) -> Column:
        bare = F.regexp_replace(F.trim(_clip_collapsed(t, 110)), r"(?U)^[•\s]+", "")
        return F.regexp_replace(bare, K.EVIDENCE_COUNT_PREFIX, "")

    def worth(t: Column) -> Column:
        """Whatever earns a point holds one of these; most tokens are plain words and need no patterns."""
        return t.contains(".") | t.contains("/") | has_any(t, [m for m, _ in K.EVIDENCE_CONTAINS if "." not in m])

    ranked = F.array_sort(
        F.filter(
            F.transform(
                F.filter(tokens, worth),
                lambda t, i: let(
                    tidy(t),
                    lambda k: F.struct((-evidence_score(k)).alias("rank"), i.alias("pos"), k.alias("text")),
                ),
            ),
            lambda x: x["rank"] < 0,
        )
    )
    names = F.array_distinct(F.transform(ranked, lambda x: x["text"]))
    return F.array_join(F.slice(names, 1, limit), " / ")


def _clip_collapsed(c: Column, limit: int) -> Column:
    return let(collapse(c), lambda s: _clip(s, limit))


# ---- small predicates and names ---------------------------------------------

def contains_any(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def is_toolish(c: Column) -> Column:
    return let(collapse(c), lambda s: contains_any(s, K.TOOLISH_MARKERS))


def is_abstract(c: Column) -> Column:
    def judge(s: Column) -> Column:
        hits = F.lit(0)
        for m in K.ABSTRACT_MARKERS:
            hits = hits + s.contains(m).cast("int")
        return (s == "") | (~s.rlike(K.CONCRETE_TOKEN) & (hits >= 2))

    return let(F.trim(text_of(c)), judge)


def has_retryable_error(c: Column) -> Column:
    return let(F.lower(text_of(c)), lambda s: contains_any(s, K.RETRYABLE_TOKENS))


def safe_file_title(c: Column, limit: int = 80) -> Column:
    bare = F.regexp_replace(collapse(c), K.FILENAME_FORBIDDEN, "-")
    tidy = F.regexp_replace(F.trim(collapse(bare)), "^[ .]+|[ .]+$", "")
    return let(
        tidy,
        lambda s: F.when(F.length(s) > limit, F.rtrim(F.substring(s, 1, limit))).otherwise(s),
    )


def display_number(stem: Column) -> Column:
    """Display number of an image file stem ``…-dN``; 1 when there is none."""
    found = F.regexp_extract(text_of(stem), r"-d(\d+)$", 1)
    return F.coalesce(found.try_cast("int"), F.lit(1))


def url_authority(url: Column) -> Column:
    """Host with user and port, as it stands in the URL; '' when there is none."""
    return F.regexp_extract(text_of(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def context_label(app: Column, domain: Column, title: Column) -> Column:
    """Distinct non-blank parts joined by `` / ``."""
    parts = F.array_distinct(
        F.filter(F.array(strip_ws(text_of(app)), strip_ws(text_of(domain)), shorten(title)), lambda p: p != "")
    )
    return let(
        F.array_join(parts, " / "),
        lambda s: F.when(s == "", F.lit(K.UNKNOWN_LABEL)).otherwise(s),
    )


def key_label(key: Column) -> Column:
    """Label of a ``segment_key`` struct: non-blank parts joined, duplicates kept."""
    parts = F.filter(F.array(key["app"], key["domain"], key["title"]), lambda p: F.trim(p) != "")
    return let(
        F.array_join(F.transform(parts, lambda p: F.trim(p)), " / "),
        lambda s: F.when(s == "", F.lit(K.UNKNOWN_LABEL)).otherwise(s),
    )


def labelled_json(c: Column) -> Column:
    """The JSON object inside free text: from the first ``{`` to the last ``}``."""
    return F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0)


def json_chars(c: Column) -> Column:
    """Size of a struct as compact JSON, in characters."""
    return F.length(F.to_json(c))
