"""Driver queries: importing this package fills ``ledgerlight.registry.REGISTRY``."""

from ledgerlight.queries import fact_queries, operator_queries, report_queries  # noqa: F401
from ledgerlight.queries import load_queries  # noqa: F401  (after fact_queries: reuses their oracles)
from ledgerlight.queries import summary_queries  # noqa: F401  (after report_queries)
