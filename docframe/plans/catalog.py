"""All registered queries."""

from docframe.plans import chunks, flows, reports, search, structure, tables  # noqa: F401
from docframe.plans.registry import ORACLES, QUERIES  # noqa: F401
