"""All registered queries."""

from vacanta.plans import catalog_jobs, catalog_prep, catalog_reports, catalog_stats, catalog_text  # noqa: F401
from vacanta.plans.registry import ORACLES, QUERIES  # noqa: F401
