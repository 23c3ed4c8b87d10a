"""Plumbline: batch jobs that audit classifiers from their prediction logs, on Spark."""
