"""Imports every module that registers queries."""

from tidemark.plans import panel_queries, replay_queries, screen_queries, table_queries  # noqa: F401
