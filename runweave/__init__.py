"""Trace metrics and run comparison as Spark DataFrame transforms.

All runs and iterations live in one long table per trace event, keyed by
``(wa_path, iteration)``; every metric is a lazy DataFrame over those tables.
"""

from runweave.config import Options
from runweave.trace import RUN_KEYS, Trace

__all__ = ["Options", "RUN_KEYS", "Trace"]
