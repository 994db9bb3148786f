"""Gridded, gauge and event-log analytics as plain ``DataFrame -> DataFrame`` functions."""

from gridloom.gridspec import GridSpec
from gridloom.session import build_session, shared_dir

__all__ = ["GridSpec", "build_session", "shared_dir"]
