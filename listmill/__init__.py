"""Mailing-list archives and catalogue pages as Spark tables."""
