"""Detection rules: each maps calls, results or sessions to findings."""
