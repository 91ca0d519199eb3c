"""Readers and writers of the tables, diagrams, programs and results."""
