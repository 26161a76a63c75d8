"""Registered queries."""

from tessera.plans import audits, chunks, evidence, graphs, knowledge, ordered, pipelines, reasoning, records, retrieval, statistics, texts  # noqa: F401
from tessera.plans.registry import QUERIES, SQL  # noqa: F401
