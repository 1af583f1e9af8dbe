"""All named queries over the driver's tables."""

from . import assembly, contracts, documents, evidence, recovery, regions, reports, structure, textual  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
