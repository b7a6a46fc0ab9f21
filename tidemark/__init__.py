"""Snapshot, change-log and restore analytics as Spark jobs."""

from tidemark.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
