"""Operators on bar panels, equity curves, trades and orders: DataFrame in, DataFrame out."""
