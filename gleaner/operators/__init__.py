"""Operators over the tables of the data model; each takes and returns DataFrames."""
