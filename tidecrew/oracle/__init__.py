"""Independent SQL statements of the same results, for a plain SQL engine over the benchmark tables."""
