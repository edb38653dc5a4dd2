"""Registry of the library's queries: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from siltstone.plans import answers, cards, catalog, core, crawl, entities, export, signs, stored, texts

_MODULES = (core, texts, entities, catalog, crawl, export, answers, stored, cards, signs)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.QUERIES.sql.items()}
