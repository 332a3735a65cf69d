"""Reading feature tables, logs and trajectories, and writing what analyses make."""
