"""Operators that explain and plan out-of-core graph work; each takes and returns DataFrames."""
