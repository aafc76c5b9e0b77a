"""Every registered query by name, with the SQL that checks it."""

from lexiforge.plans import calibration_queries, file_queries, knowledge_queries, model_queries, pair_queries, report_queries, text_queries  # noqa: F401  (they register)
from lexiforge.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
