"""DataFrame-to-DataFrame operators, grouped by family."""
