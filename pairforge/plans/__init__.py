"""Whole pipelines made of sources, operators and sinks."""
