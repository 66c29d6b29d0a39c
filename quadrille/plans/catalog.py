"""All registered queries of the engine with their SQL oracles."""

from quadrille.plans import cleaning_queries, context_queries, model_queries, more_queries, operations_queries, panel_queries, roundtrip_queries, text_queries  # noqa: F401
from quadrille.plans import sql_queries  # noqa: F401, I001  its SQL is that of the queries above
from quadrille.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
