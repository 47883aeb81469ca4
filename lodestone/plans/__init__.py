"""Registered queries, one module for each family of operators."""

from lodestone.plans import cloning, coding, graphs, scanning, stores, texts
from lodestone.plans.scanning import flagship

MODULES: list = [scanning, texts, cloning, graphs, coding, stores]

__all__ = ["MODULES", "flagship"]
