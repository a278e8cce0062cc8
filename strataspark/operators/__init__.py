"""Operators over DataFrames of observations, units, faults and traces."""
