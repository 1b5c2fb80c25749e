"""Guideline-conflict analytics as Spark DataFrame plans."""
