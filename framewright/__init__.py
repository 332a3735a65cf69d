"""Spark-first analytics over keyed, ordered measurement series."""

__version__ = "0.1.0"
