"""The queries of the recording engine, by name, and their SQL."""

from __future__ import annotations

from tidelog.plans import conversions, more, recordings, surface

QUERIES = surface.QUERIES | recordings.QUERIES | conversions.QUERIES | more.QUERIES
ORACLES = surface.ORACLES | recordings.ORACLES | conversions.ORACLES | more.ORACLES
FLAGSHIP = recordings.QUERIES["rec_topic_counts"]
