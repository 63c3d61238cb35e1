"""Movement analytics on Spark: window counts, as-of joins, references with fallback, diagnostics and more."""
