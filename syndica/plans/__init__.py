"""Whole pipelines: one plan per page dialect, probing and publishing."""
