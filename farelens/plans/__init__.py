"""Flows that put operators together: the route report and the summary with its prompts."""

from farelens.plans.pricing_summary import pricing_summary
from farelens.plans.route_report import route_report, write_route_report

__all__ = ["pricing_summary", "route_report", "write_route_report"]
