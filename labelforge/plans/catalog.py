"""All registered queries."""
from . import match_queries, ocr_queries, product_queries, rules_queries, sources_queries, sql_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
