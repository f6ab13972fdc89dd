"""Operators: DataFrame in, DataFrame out. Positions are 0-based and half-open."""
