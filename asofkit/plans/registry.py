"""All registered queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from asofkit.plans import admission, builds, campaigns, desk, evaluation, files, market, overnight, regimes, research, sweeps, trials

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (market, research, evaluation, admission, files, regimes, desk, campaigns, sweeps, trials, overnight, builds):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
