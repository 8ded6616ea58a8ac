"""All registered queries and their SQL."""

from topshare.plans import (
    audit_queries,
    cleaning_queries,
    concentration_queries,
    io_queries,
    sampling_queries,
    text_queries,
)

_MODULES = [
    concentration_queries,
    cleaning_queries,
    sampling_queries,
    text_queries,
    audit_queries,
    io_queries,
]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
