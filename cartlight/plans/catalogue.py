"""Loads every query module once."""

from __future__ import annotations

import importlib

from cartlight.plans import views  # noqa: F401
from cartlight.plans.registry import ORACLES, QUERIES

FAMILIES = ["voucher", "catalog", "search", "scoring", "trajectory", "folding", "groups", "advantage", "answers", "selection", "splits", "sources", "planning", "training", "streaming"]


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"cartlight.plans.{family}_queries")


__all__ = ["load", "QUERIES", "ORACLES"]
