"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from treeline.plans import graphs, logs, services, structure, text  # noqa: F401  they register what they hold
from treeline.plans.registry import ORACLES, QUERIES

FLAGSHIP = "html_links_in_nav"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
