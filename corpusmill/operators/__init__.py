"""Processors: the steps that a configuration names."""
