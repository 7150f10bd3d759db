"""Table-scale redaction and its audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import redact as R
from daymill.functions import text as T


def _count(text: Column, pattern: str, worth: Column | None = None) -> Column:
    n = F.regexp_count(text, F.lit(pattern))
    return n if worth is None else F.when(worth, n).otherwise(0)


def hit_counts(text: Column, hints: list[str] | None = None, key_names: list[str] | None = None) -> dict[str, Column]:
    """Hits per rule in one text, each rule on the text as it stands."""
    names = R.worth_looking(key_names or K.SECRET_KEY_NAMES)
    secrets = _count(text, R.secret_pair_pattern(key_names), names(text))
    for pattern, _, sign in K.SECRET_PATTERNS:
        secrets = secrets + _count(text, pattern, text.contains(sign))
    terms = F.lit(0)
    for pattern, _, signs in K.SENSITIVE_PATTERNS:
        terms = terms + _count(text, pattern, T.has_any(T.folded(text), signs))
    return {
        "email": _count(text, K.EMAIL, text.contains("@")),
        "phone": _count(text, K.PHONE),
        "card": F.size(R.card_hits(text)),
        "auth": _count(text, R.auth_pattern(hints), R.worth_looking(hints or K.AUTH_HINTS)(text)),
        "secret": secrets,
        "term": terms,
    }


def redaction_audit(
    df: DataFrame, text: str, by: Sequence[str],
    hints: list[str] | None = None, key_names: list[str] | None = None,
) -> DataFrame:
    """Hits per rule and group, as rows ``by, rule, hits, texts_hit``."""
    counts = hit_counts(F.col(text), hints, key_names)
    one = df.select(*by, *[c.cast("long").alias(n) for n, c in counts.items()])
    sums = one.groupBy(*by).agg(
        *[F.struct(F.sum(n).alias("hits"), F.count_if(F.col(n) > 0).alias("texts_hit")).alias(n) for n in counts])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n)["hits"].alias("hits"), F.col(n)["texts_hit"].alias("texts_hit")) for n in counts])
    return sums.select(*by, F.explode(pairs).alias("_r")).select(*by, "_r.rule", "_r.hits", "_r.texts_hit")
