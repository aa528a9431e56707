"""Relational analytics over positioned, scored symbol detections, on Spark DataFrames."""
