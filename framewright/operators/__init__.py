"""Operators on DataFrames: relational ones as plans, kernels in Arrow functions where no built-in exists."""
