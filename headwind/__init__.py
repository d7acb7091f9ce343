"""Headwind: punctuality analytics expressed as Spark DataFrame plans."""
