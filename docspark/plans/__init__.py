"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from docspark.plans import (  # noqa: F401
    catalog,
    detection,
    evaluation,
    identity,
    language_model,
    logs,
    markup,
    rewriting,
    segmentation,
    storage,
    uploads,
    users,
)
from docspark.plans import streams  # noqa: F401  (builds on the batch queries above)
from docspark.plans.registry import QUERIES, Tables  # noqa: F401
