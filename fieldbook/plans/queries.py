"""All queries: importing the catalogues registers theirs."""

from fieldbook.plans import catalogue, catalogue_labels, catalogue_runs, catalogue_samples  # noqa: F401
from fieldbook.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
