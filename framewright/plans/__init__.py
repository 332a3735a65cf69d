"""Whole analyses: the pipeline object, the planner of shared passes, the operator registry, the driver's queries."""
