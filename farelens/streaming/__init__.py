"""The stateless row formulas on streams, and results kept by question."""

from farelens.streaming.quotes import price_requests, read_requests, write_quotes
from farelens.streaming.results import latest_results, read_results, write_results

__all__ = ["latest_results", "price_requests", "read_requests", "read_results", "write_quotes", "write_results"]
