"""All registered queries."""

from labelweave.plans import catalog_labels, catalog_models, catalog_reports, catalog_tables, catalog_vectors  # noqa: F401
from labelweave.plans.catalog import ORACLES, QUERIES  # noqa: F401
