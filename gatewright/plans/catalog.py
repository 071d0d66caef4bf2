"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from gatewright.plans.oracles import ORACLES
from gatewright.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
