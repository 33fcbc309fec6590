"""Operators for training data. Nothing outside this folder imports it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("clusters", "lookalike", "language", "privacy", "neardup", "abuse", "tokens", "packing", "quality")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        try:
            out |= import_module(f"{__name__}.{m}").QUERIES
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        try:
            out |= getattr(import_module(f"{__name__}.{m}"), "SQL", {})
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
    return out
