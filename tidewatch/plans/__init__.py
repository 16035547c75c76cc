"""Whole pipelines: panels, staged decisions, reports, replay."""
