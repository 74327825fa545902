"""Every query of the core, with the SQL it is checked against."""

from __future__ import annotations

from epochloom.plans import common, problems, relational, series, statistics  # noqa: F401

FLAGSHIP = "phase_means"

QUERIES = {
    "p1_found": problems.p1_found,
    "p3_found": problems.p3_found,
    "p3_flags": problems.p3_flags,
    "p3_kinds": problems.p3_kinds,
    "p4_found": problems.p4_found,
    "p4_report": problems.p4_report,
    "p6_found": problems.p6_found,
    "p6_grid": problems.p6_grid,
    "p6_cells": problems.p6_cells,
} | common.QUERIES

SQL = {
    "p1_found": problems.P1_SQL,
    "p3_found": problems.P3_SQL,
    "p3_kinds": problems.P3_KINDS_SQL,
    "p4_found": problems.P4_SQL,
    "p4_report": problems.P4_REPORT_SQL,
    "p6_found": problems.P6_SQL,
    "p6_cells": problems.P6_CELLS_SQL,
} | common.SQL
