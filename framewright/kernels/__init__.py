"""NumPy kernels that Arrow functions call on one bounded group at a time; none of them knows Spark."""
