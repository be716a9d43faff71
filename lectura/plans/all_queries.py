"""Importing this module registers every query; the order is that of the shared definitions."""

# isort: off
from lectura.plans import ctes  # noqa: F401
from lectura.plans import text_queries  # noqa: F401
from lectura.plans import study_queries  # noqa: F401
from lectura.plans import event_queries  # noqa: F401
from lectura.plans import song_queries  # noqa: F401
from lectura.plans import bundle_queries  # noqa: F401
from lectura.plans.registry import ORACLES, QUERIES  # noqa: F401
