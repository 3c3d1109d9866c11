"""All queries of the library over the given tables, with their SQL."""

from __future__ import annotations

from neurotab.plans import built, events, lookups, measures, sales, signals, summaries, texts, tracks, trials, vectors

MODULES = (built, events, lookups, measures, sales, signals, summaries, texts, tracks, trials, vectors)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
