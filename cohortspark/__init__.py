"""Cohort analytics over sequencing evidence, expressed as Spark plans."""
