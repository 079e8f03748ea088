"""Named queries of the engine and their SQL."""

from . import graphs, perturbations, policies, records, samples, statistics, texts, verification

_MODULES = (verification, texts, perturbations, samples, policies, graphs, statistics, records)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
