"""Endurance-training analytics and corpus operators on PySpark DataFrames."""
