"""All registered queries. Importing the catalog modules fills the registry."""

from panelstat.plans import (catalog_eval, catalog_indicators, catalog_lookup, catalog_profile,  # noqa: F401
                             catalog_questions,
                             catalog_records, catalog_sources, catalog_status, catalog_stream, catalog_survey)
from panelstat.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
