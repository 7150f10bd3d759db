"""Whole jobs composed from operators: day snapshot, reports, query catalogue."""
