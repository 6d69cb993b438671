"""What the driver's entry file registers."""

from __future__ import annotations

from gridspark.llm.oracles import ORACLES
from gridspark.llm.queries import QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v.strip() for k, v in ORACLES.items()}
