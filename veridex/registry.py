"""Queries of the library by name, and the SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from .operators import answers, blocks, calibration, chunking, conversations, evaluation, folds, locators, manifests, ranking, retrieval, search, text, versions  # noqa: F401
from .plans.run import oracle, query
from .streaming import ingest, limits

OPERATORS = retrieval.OPERATORS | versions.OPERATORS | text.OPERATORS | conversations.OPERATORS | evaluation.OPERATORS
QUERIES: dict[str, Callable] = {name: query(build) for name, build in OPERATORS.items()} | folds.QUERIES | answers.QUERIES | blocks.QUERIES | calibration.QUERIES | ranking.QUERIES | chunking.QUERIES | locators.QUERIES | manifests.QUERIES | ingest.QUERIES | limits.QUERIES
ORACLES: dict[str, str] = {name: oracle(build) for name, build in OPERATORS.items()} | answers.ORACLES | blocks.ORACLES | calibration.ORACLES | ranking.ORACLES | chunking.ORACLES | locators.ORACLES | manifests.ORACLES | ingest.ORACLES
