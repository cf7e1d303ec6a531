"""All registered queries; importing a module registers its queries."""

from sheetwise.plans import numbers, questions, tables, texts  # noqa: F401
from sheetwise.plans.registry import ORACLES, QUERIES  # noqa: F401
