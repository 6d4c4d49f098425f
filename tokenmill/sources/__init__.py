"""Readers and writers (scans, sinks)."""

from tokenmill.sources.io import *  # noqa: F401,F403
