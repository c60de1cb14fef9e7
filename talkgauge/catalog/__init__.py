"""All registered queries over the driver tables. Importing the modules registers what they hold."""

from talkgauge.catalog import chinese, grouping, matching, scripting, storing, texts  # noqa: F401
from talkgauge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
