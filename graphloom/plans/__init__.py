"""Plan-level helpers: lineage cuts, fixpoints and the query catalogue."""
