"""Scholarly-affiliation analytics as composable Spark DataFrame operators."""
