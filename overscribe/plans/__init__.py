"""Queries: every operator over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import assembly, evaluation, retrieval, state, texts
from .common import REGISTRY, SQL

__all__ = ["REGISTRY", "SQL", "assembly", "evaluation", "retrieval", "state", "texts"]
