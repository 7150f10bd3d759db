"""Registration, flattening and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT; dates, times and arrays as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return flat(fn(spark, sf))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_parts(sql)
        return fn

    return register


TS = "'%Y-%m-%d %H:%M:%S.%f'"

# SQL twins of the adapters and of the shared stages, in dependency order.
PARTS: dict[str, str] = {
    "ev0": """SELECT 'd' || CAST(user_id % 5 AS VARCHAR) AS source_id, CAST(ts AS DATE) AS day, event_id AS seq,
        CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 17 = 3 THEN 'e' || CAST(event_id - 3 AS VARCHAR)
             ELSE 'e' || CAST(event_id AS VARCHAR) END AS id,
        ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS app,
        CASE WHEN user_id % 2 = 0 THEN 'u' || CAST(user_id % 3 AS VARCHAR) || '.example.com' ELSE '' END AS dom,
        event_type = 'error' AS err, event_id % 13 = 0 AS old, event_id % 7 = 0 AS off1, event_id % 11 = 0 AS off2,
        event_id % 2 + 1 AS act, user_id, value FROM events""",
    "ev": """SELECT *, CASE WHEN k % 10 = 0 THEN 0 ELSE 720 END AS ivl,
        (NOT err AND NOT old AND off1 AND off2) AS excl,
        CASE WHEN dom = '' THEN app ELSE app || ' / ' || dom END AS label,
        date_trunc('hour', ts) AS hr FROM ev0""",
    "dflt": """SELECT source_id, day, COALESCE(NULLIF(arg_max(ivl, seq), 0), 300) AS d FROM ev GROUP BY source_id, day""",
    "tm": """SELECT ev.*, dflt.d, CAST(COALESCE(NULLIF(ev.ivl, 0), dflt.d) AS BIGINT) AS dur
        FROM ev JOIN dflt ON ev.source_id = dflt.source_id AND ev.day = dflt.day""",
    "val": "SELECT * FROM tm WHERE NOT excl AND NOT err",
    "ses1": """SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR lag(app) OVER w <> app OR lag(dom) OVER w <> dom
             OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > greatest(120, CAST(floor(d * 2.5) AS BIGINT)) * 1000000
             THEN 1 ELSE 0 END AS brk
        FROM val WINDOW w AS (PARTITION BY source_id, day ORDER BY ts, seq)""",
    "ses": """SELECT *, CAST(sum(brk) OVER (PARTITION BY source_id, day ORDER BY ts, seq
        ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS seg FROM ses1""",
    "segt": """SELECT source_id, day, seg, min(ts) AS start_ts,
        max(ts) + to_seconds(CAST(arg_max(dur, (ts, seq)) AS BIGINT)) AS end_ts, CAST(sum(dur) AS BIGINT) AS duration_sec,
        count(*) AS captures, any_value(app) AS app, any_value(dom) AS dom, any_value(label) AS label
        FROM ses GROUP BY source_id, day, seg""",
    "tr": """SELECT s.* EXCLUDE (seg, label), CASE WHEN s.id = '' THEN NULL ELSE m.seg END AS seg,
        CASE WHEN s.id = '' THEN '' ELSE t.label END AS label
        FROM ses s LEFT JOIN (SELECT source_id, day, id, max(seg) AS seg FROM ses WHERE id <> '' GROUP BY ALL) m
          ON s.source_id = m.source_id AND s.day = m.day AND s.id = m.id
        LEFT JOIN segt t ON m.source_id = t.source_id AND m.day = t.day AND m.seg = t.seg""",
    "docn": "SELECT count(*) AS n FROM documents",
    "flatdoc": """SELECT doc_id, text, trim(regexp_replace(regexp_replace(text,
        '[\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'),
        '\\bDEV[l|]([A-Za-z])', 'DEV/\\1', 'g')) AS flat FROM documents""",
    "coldoc": """SELECT doc_id, trim(regexp_replace(text,
        '[\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS col
        FROM documents""",
    # ---- fixed values: patterns of URLs, files, paths and markers, stated for the SQL engine ----
    "docurl0": """SELECT doc_id, 0 AS grp, unnest(u) AS tok, generate_subscripts(u, 1) AS idx FROM (
          SELECT doc_id, regexp_extract_all(flat, '(?i)\\bhttps?://[^\\s<>()]+') AS u FROM flatdoc)
        UNION ALL SELECT doc_id, 1, unnest(b), generate_subscripts(b, 1) FROM (
          SELECT doc_id, list_filter(regexp_extract_all(flat,
            '(?i)\\b(?:[A-Za-z0-9-]+\\.)+(?:com|net|org|io|ai|app|dev|co|jp)(?:/[^\\s<>()]+)?\\b'),
            lambda d: NOT contains(flat, '/' || d)) AS b FROM flatdoc)""",
    "docurl": """SELECT doc_id, tok, min((grp, idx)) AS ord_at FROM (SELECT doc_id, grp, idx,
          CASE WHEN regexp_matches(r, '(?i)^https?://') AND regexp_extract(r, '(?i)^https?://([^/?#]*)', 1) <> ''
               THEN regexp_extract(r, '(?i)^https?://([^/?#]*)', 1)
                 || regexp_replace(regexp_extract(r, '(?i)^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') ELSE r END AS tok
          FROM (SELECT *, regexp_replace(tok, '[).,;:】]+$', '') AS r FROM docurl0)) WHERE tok <> '' GROUP BY doc_id, tok""",
    "docfile": """SELECT doc_id, unnest(f) AS tok, generate_subscripts(f, 1) AS idx FROM (SELECT doc_id, regexp_extract_all(flat,
          '(?i)(?:^|[^\\p{L}\\p{N}_/.-])([\\p{L}\\p{N}_./-]*\\.?(?:[\\p{L}\\p{N}_./-]+)\\.(?:py|md|txt|json|jsonl|toml|ya?ml|sh|zsh|bash|ts|js|tsx|jsx|go|rs|swift|java|kt|rb|php|csv|tsv|log|env|ini|cfg|conf|sql|sqlite|db|png|jpe?g|gif|webp|pdf|zip|gz|tgz|tar|app))\\b', 1) AS f FROM flatdoc)""",
    "docpath": """SELECT doc_id, tok, min(idx) AS idx FROM (SELECT doc_id, unnest(p) AS tok, generate_subscripts(p, 1) AS idx FROM (
          SELECT f.doc_id, list_concat(regexp_extract_all(f.flat, '(?i)(?:^|\\s)(/(?:Users|Applications|System|Volumes|opt|etc|var|tmp|private|Library)/[^\\s]+)', 1),
            regexp_extract_all(replace(f.text, chr(10), ''), '(?i)(?:^|\\s)(/(?:Users|Applications|System|Volumes|opt|etc|var|tmp|private|Library)/[^\\s]+)', 1)) AS p
          FROM flatdoc f)) GROUP BY doc_id, tok""",
    "docstrong": """SELECT doc_id, tok, (0, 0, idx) AS ord_at FROM docfile UNION ALL SELECT doc_id, tok, (1, 0, idx) FROM docpath
        UNION ALL SELECT doc_id, tok, (2, ord_at[1], ord_at[2]) FROM docurl
        UNION ALL SELECT doc_id, m, (3, 0, i) FROM flatdoc, (VALUES ('2>&1', 1), ('platform.openai.com', 2), ('chatgpt.com', 3), ('github.com', 4)) v(m, i)
          WHERE contains(flat, m)""",
    "docweak": """SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS idx FROM (SELECT doc_id,
          list_concat(regexp_extract_all(flat, '[A-Za-z0-9_./-]{4,}'), regexp_extract_all(flat, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9faf}]{2,}')) AS w FROM flatdoc)""",
    "dochit": """SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(left(t, 79)) || '…' ELSE t END AS token, ord_at FROM (
        SELECT doc_id, ord_at, regexp_replace(regexp_replace(tok, '\\bsk-[A-Za-z0-9_\\-]{12,}\\b', 'sk-…', 'g'),
          '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[REDACTED_EMAIL]', 'g') AS t FROM (
          SELECT doc_id, tok, ord_at FROM docstrong UNION ALL
          SELECT doc_id, tok, (4, 0, idx) FROM docweak WHERE doc_id NOT IN (SELECT doc_id FROM docstrong)))""",
    "docsent0": """SELECT doc_id, unnest(ss) AS sent, generate_subscripts(ss, 1) AS pos FROM (
        SELECT doc_id, string_split(regexp_replace(regexp_replace(flat, '[▶→・|•]', '。', 'g'),
          '([。.!?！？]) +', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM flatdoc)""",
    "docsent": """SELECT doc_id, pos, sent, regexp_replace(lower(sent),
        '["''“”‘’（）()【】\\[\\]<>、。.!?！？・|•▶→]', '', 'g') AS norm FROM docsent0 WHERE sent <> ''""",
    "disp": """SELECT t.source_id, t.day, t.seg, t.seq, t.id, t.ts, t.hr, t.app, t.dom, t.act, x.display, x.doc
        FROM (SELECT *, CAST(floor(seq / 4) AS BIGINT) % (SELECT n FROM docn) AS d1 FROM tr WHERE seg IS NOT NULL AND NOT old) t
        CROSS JOIN LATERAL (SELECT 1 AS display, t.d1 AS doc WHERE NOT t.off1
          UNION ALL SELECT 2, (t.d1 + 1) % (SELECT n FROM docn) WHERE NOT t.off2) x""",
    "ent": """SELECT d.*, f.flat FROM disp d JOIN flatdoc f ON d.doc = f.doc_id WHERE f.flat <> ''""",
    "docnorm": """SELECT doc_id, norm, min(pos) AS pos, arg_min(sent, pos) AS sent FROM docsent WHERE norm <> '' GROUP BY doc_id, norm""",
    "cnt": """SELECT e.source_id, e.day, e.seg, e.display, n.norm, count(*) AS entries,
        min((e.ts, e.seq, n.pos)) AS first_at, arg_min(n.sent, (e.ts, e.seq, n.pos)) AS sent,
        arg_min(e.seq, (e.ts, e.seq, n.pos)) AS seq, arg_min(n.pos, (e.ts, e.seq, n.pos)) AS pos
        FROM ent e JOIN docnorm n ON e.doc = n.doc_id GROUP BY ALL""",
    "common": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, day, seg, display
        ORDER BY entries DESC, first_at) AS rank FROM cnt WHERE entries >= 2)""",
    "newt": """SELECT e.source_id, e.day, e.seg, e.display, e.seq, e.id, e.ts, e.hr, e.app, e.dom, e.act = e.display AS active,
        COALESCE(u.txt, f.sent) AS txt
        FROM ent e LEFT JOIN (SELECT source_id, day, seg, display, seq, string_agg(sent, ' / ' ORDER BY pos) AS txt
            FROM cnt WHERE entries = 1 GROUP BY ALL) u
          ON e.source_id = u.source_id AND e.day = u.day AND e.seg = u.seg AND e.display = u.display AND e.seq = u.seq
        LEFT JOIN (SELECT doc_id, arg_min(sent, pos) AS sent FROM docsent GROUP BY doc_id) f ON e.doc = f.doc_id""",
    "hours": """SELECT source_id, day, hr, CAST(sum(dur) AS BIGINT) AS active_sec FROM tm GROUP BY source_id, day, hr""",
    "ivlid": "SELECT source_id, day, id, arg_max(dur, seq) AS id_sec FROM tm WHERE id <> '' GROUP BY ALL",
    "clu0": """SELECT a.source_id, a.day, a.hr, a.app, a.dom, CASE WHEN a.dom = '' THEN a.app ELSE a.app || ' / ' || a.dom END AS label,
        CAST(sum(i.id_sec) AS BIGINT) AS active_sec
        FROM (SELECT DISTINCT source_id, day, hr, app, dom, id FROM newt WHERE active) a
        LEFT JOIN ivlid i ON a.source_id = i.source_id AND a.day = i.day AND a.id = i.id GROUP BY ALL""",
    "clu1": """SELECT c.*, s.segs FROM clu0 c JOIN (SELECT source_id, day, hr, app, dom,
        list_sort(list_distinct(list(seg))) AS segs FROM newt WHERE active GROUP BY ALL) s
        ON c.source_id = s.source_id AND c.day = s.day AND c.hr = s.hr AND c.app = s.app AND c.dom = s.dom""",
    "clu": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, day, hr ORDER BY active_sec DESC, label, app) AS rank
        FROM clu1)""",
    "tl": """SELECT * EXCLUDE (n) FROM (SELECT w.*, c.rank, c.label, row_number() OVER (PARTITION BY w.source_id, w.day, w.hr, w.app, w.dom, w.id
        ORDER BY w.ts, w.seq) AS n FROM newt w JOIN clu c ON w.source_id = c.source_id AND w.day = c.day AND w.hr = c.hr
          AND w.app = c.app AND w.dom = c.dom WHERE w.active) WHERE n = 1 AND trim(txt) <> ''""",
    "hcom": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, day, hr
            ORDER BY places DESC, length(txt) DESC, fs, norm) AS rank FROM (
        SELECT l.source_id, l.day, l.hr, c.n240 AS norm, count(*) AS places,
          arg_min(c.sent, (l.seg, l.display, c.rank)) AS txt, min((l.seg, l.display, c.rank)) AS fs
        FROM (SELECT DISTINCT source_id, day, hr, seg, display FROM newt) l
        JOIN (SELECT source_id, day, seg, display, replace(norm, ' ', '') AS n240,
                min(rank) AS rank, arg_min(sent, rank) AS sent FROM common WHERE replace(norm, ' ', '') <> '' GROUP BY source_id, day, seg, display, replace(norm, ' ', '')) c
          ON l.source_id = c.source_id AND l.day = c.day AND l.seg = c.seg AND l.display = c.display
        GROUP BY ALL))""",
    "kept": """SELECT DISTINCT c.source_id, c.day, c.hr, c.rank, c.label, c.app, c.dom, c.segs FROM clu c JOIN tl
        ON c.source_id = tl.source_id AND c.day = tl.day AND c.hr = tl.hr AND c.app = tl.app AND c.dom = tl.dom""",
    "pack": """SELECT h.source_id, h.day, h.hr, h.active_sec, COALESCE(k.labels, []) AS labels, COALESCE(c.texts, []) AS texts,
          COALESCE(o.txt, c.texts[1]) AS obs0
        FROM hours h
        LEFT JOIN (SELECT source_id, day, hr, list(label ORDER BY rank) AS labels FROM kept GROUP BY ALL) k
          ON h.source_id = k.source_id AND h.day = k.day AND h.hr = k.hr
        LEFT JOIN (SELECT source_id, day, hr, list(txt ORDER BY rank) AS texts FROM hcom GROUP BY ALL) c
          ON h.source_id = c.source_id AND h.day = c.day AND h.hr = c.hr
        LEFT JOIN (SELECT source_id, day, hr, arg_min(txt, (rank, ts, id)) AS txt FROM tl GROUP BY ALL) o
          ON h.source_id = o.source_id AND h.day = o.day AND h.hr = o.hr""",
    "packs": """SELECT source_id, day, hr, active_sec, labels, texts, strftime(hr, '%Y-%m-%dT%H:00:00') || '+00:00' AS hour_start_ts,
          strftime(hr, '%Y-%m-%dT%H:59:59') || '+00:00' AS hour_end_ts,
          CASE WHEN length(trim(COALESCE(obs0, ''))) > 80 THEN rtrim(left(trim(obs0), 79)) || '…' ELSE trim(COALESCE(obs0, '')) END AS obs
        FROM pack""",
    # Hour roll-up used by the week queries: top context as title, contexts by seconds as labels.
    "hctx": """SELECT source_id, day, hr, app, CAST(sum(dur) AS BIGINT) AS sec FROM tm GROUP BY ALL""",
    "hrow": """SELECT h.source_id, h.day, h.hr, h.active_sec, l.labels,
          'Work on ' || l.labels[1] AS title,
          CASE WHEN extract(hour FROM h.hr) % 3 = 0 THEN '' ELSE 'Spent time on ' || array_to_string(l.labels, ', ') || '.' END AS summary
        FROM hours h JOIN (SELECT source_id, day, hr, list(app ORDER BY sec DESC, app) AS labels FROM hctx GROUP BY ALL) l
          ON h.source_id = l.source_id AND h.day = l.day AND h.hr = l.hr""",
    "hidx": """SELECT *, CAST(row_number() OVER (PARTITION BY source_id, day ORDER BY hr) - 1 AS BIGINT) AS idx FROM hrow""",
    "snap": """SELECT source_id, day, CAST(sum(active_sec) AS BIGINT) AS total, count(*) AS n_hours,
          CASE WHEN count(*) >= 23 THEN 'complete' ELSE 'incomplete' END AS status,
          CASE WHEN count(*) >= 23 THEN '' ELSE 'hourly_label_missing:' || CAST(24 - count(*) AS VARCHAR) END AS reason,
          CAST(date_trunc('week', day) AS DATE) AS week_start FROM hrow GROUP BY source_id, day""",
}


def with_parts(sql: str) -> str:
    """Prefix the query with the fragments it needs, in dependency order."""
    import re

    names = list(PARTS)
    need: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\b[a-z0-9]+\b", todo.pop()))
        for n in names:
            if n in words and n not in need:
                need.add(n)
                todo.append(PARTS[n])
    body = sql.strip()
    if not need:
        return body
    heads = ",\n".join(f"{n} AS ({PARTS[n]})" for n in names if n in need)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def near_duplicate_sql(a: str, b: str) -> str:
    """SQL of the near-duplicate rule for two text expressions."""
    strip = "[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{3000}、。.,!?！？:：;；\\-–—/\\\\()（）「」『』【】\\[\\]{}<>＜＞\"''・]"
    norm = lambda c: f"regexp_replace(lower(trim(coalesce({c}, ''))), '{strip}', '', 'g')"
    pairs = lambda v: f"list_distinct(list_transform(range(1, greatest(length({v}) - 1, 1) + 1), lambda i: substring({v}, i, 2)))"
    return f"""(SELECT CASE WHEN x = '' OR y = '' THEN false
      WHEN x = y OR (length(x) >= 12 AND (contains(y, x) OR contains(x, y))) THEN true
      ELSE 2.0 * len(list_intersect({pairs('x')}, {pairs('y')})) / (len({pairs('x')}) + len({pairs('y')})) >= 0.88 END
      FROM (SELECT {norm(a)} AS x, {norm(b)} AS y))"""
