"""Processors on streams."""
