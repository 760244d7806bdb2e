"""Operators on DataFrames: cleaning, star build, BI, impact, quality, maintenance, panel, model."""
