"""Whole jobs composed from the operators, and the queries the driver runs."""
