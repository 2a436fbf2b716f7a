"""Whole runs: the tables at hand as inputs, registered queries, the round loop."""
