"""Windowed-signal cleaning, cohort evaluation and disclosure control on Spark DataFrames."""
