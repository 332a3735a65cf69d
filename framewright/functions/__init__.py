"""Column functions: cleaning, labels and names, vectors, time."""

from . import clean, groups, labels, time, vectors

__all__ = ["clean", "groups", "labels", "time", "vectors"]
