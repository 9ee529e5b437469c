"""Scans, sinks, object listing and the dataset/model catalog tables."""

from sparkprep.sources.io import read, write, list_objects  # noqa: F401
