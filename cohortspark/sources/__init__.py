"""Readers of cohort tables, annotations and alignments."""
