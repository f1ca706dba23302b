"""Spatial joins, statistics, votes and graph operators."""
