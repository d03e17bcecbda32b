"""Ballast: skew-aware stream analytics and corpus operators on PySpark."""
