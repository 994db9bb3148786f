"""Loads every query module, so that the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ("layer_queries", "gauge_queries", "frame_queries", "tile_queries", "event_queries", "file_queries")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"gridloom.plans.{name}")
