"""Column expressions and window builders that operators share."""
