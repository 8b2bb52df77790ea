"""Training-data operators: deduplication, scans, filters, mixing and packing.

Nothing outside this subpackage imports it.  ``tabloom.llm.queries`` holds the
registered queries and their SQL.
"""
