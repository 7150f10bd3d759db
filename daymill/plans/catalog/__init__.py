"""Named queries over the sample tables, each with its SQL twin.

A name starts with the operator id of the blueprint.  ``QUERIES[name](spark, sf_dir)``
returns a flat DataFrame; ``ORACLES[name]`` is SQL over the same tables.
"""

from __future__ import annotations

from daymill.plans.catalog import (  # noqa: F401
    ingest, jobs, labels, ledgers, rules, segments, spending, streams, texts, weeks,
)
from daymill.plans.catalog.base import ORACLES, QUERIES  # noqa: F401
