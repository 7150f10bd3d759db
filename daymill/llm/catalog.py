"""All queries of the subpackage and their SQL twins."""

from __future__ import annotations

from daymill.llm import bpe, centroids, chat, embed_dedup, fingerprints, langid, line_dedup, mixing, ngram_join, packing, phrases, token_counts, warc  # noqa: F401
from daymill.llm.base import ORACLES, QUERIES  # noqa: F401
