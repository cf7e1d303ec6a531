"""All queries of this subpackage; importing a module registers its query."""

from sheetwise.llm import archives, contamination, extraction, interactions, lines, packing, passages, pseudonyms, quality, sharding, simhash, toxicity, va_file  # noqa: F401
from sheetwise.llm.registry import ORACLES, QUERIES  # noqa: F401
