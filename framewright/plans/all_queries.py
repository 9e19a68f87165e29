"""All registered queries of the engine: importing this module fills the registry."""

from framewright.plans import catalog_queries, detection_queries, exposition_queries, panel_queries, stream_queries  # noqa: F401
from framewright.plans.registry import ORACLES, QUERIES  # noqa: F401
