"""Checked queries; importing this package fills the registry."""

from importlib import import_module

from lineward.plans.registry import QUERIES, SQL

for _part in ("keyword", "index", "table", "web", "site", "image", "scoring", "file", "report", "source"):
    try:
        import_module(f"lineward.plans.{_part}_queries")
    except ModuleNotFoundError as _e:
        if f"{_part}_queries" not in str(_e):
            raise
