"""Readers, writers and dimension tables."""

from farelens.sources.dimensions import (
    aircraft,
    flight_numbers,
    holidays,
    routes_dimension,
    subsidy_tiers,
)
from farelens.sources.flights import FlightScan, nan_to_null, read_flights, scan_flights, write_csv
from farelens.sources.shared import cut_lineage, new_folder
from farelens.sources.summaries import (
    read_document_routes,
    read_summary_elasticity,
    write_document,
    write_summary,
)

__all__ = [
    "FlightScan",
    "aircraft",
    "cut_lineage",
    "flight_numbers",
    "holidays",
    "nan_to_null",
    "new_folder",
    "read_document_routes",
    "read_flights",
    "read_summary_elasticity",
    "routes_dimension",
    "scan_flights",
    "subsidy_tiers",
    "write_csv",
    "write_document",
    "write_summary",
]
