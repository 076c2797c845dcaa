"""All named queries of the library."""

from __future__ import annotations

from meridian.plans import q_models, q_products, q_scalar, q_space, q_state, q_tables
from meridian.plans.registry import Query

REGISTRIES = [q_scalar.Q, q_tables.Q, q_space.Q, q_models.Q, q_state.Q, q_products.Q]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for r in REGISTRIES:
        if twice := set(out) & set(r.queries):
            raise ValueError(f"declared twice: {sorted(twice)}")
        out |= r.queries
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v for r in REGISTRIES for k, v in r.sql.items()}
