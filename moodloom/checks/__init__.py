"""Registered queries over the bundled tables and their SQL twins."""

from moodloom.checks import core, ingest, learn, relate  # noqa: F401
from moodloom.checks.registry import ORACLES, QUERIES  # noqa: F401
