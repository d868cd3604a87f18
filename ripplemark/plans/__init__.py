"""Queries: the operators wired to the driver's tables, each beside the SQL it equals."""
