"""All registered queries."""

from linkstrata.queries import auditing, diagnostics, preparing, quantisation, retrieval, running  # noqa: F401
from linkstrata.queries.registry import QUERIES, SQL  # noqa: F401
