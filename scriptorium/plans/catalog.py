"""Every query of the core and its SQL."""

from __future__ import annotations

from scriptorium.plans import answers, reports, retrieval, texts

QUERIES: dict = {**retrieval.QUERIES, **texts.QUERIES, **answers.QUERIES, **reports.QUERIES}
ORACLE: dict = {**retrieval.ORACLE, **texts.ORACLE, **answers.ORACLE, **reports.ORACLE}
