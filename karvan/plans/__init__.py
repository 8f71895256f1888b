"""Queries over the benchmark tables, one module per area."""

from importlib import import_module

MODULES = (
    "q_cdc", "q_history", "q_ranking", "q_catalog", "q_text", "q_extract", "q_fitment",
    "q_matching", "q_search", "q_billing", "q_streaming", "q_crawl", "q_ops", "q_sources",
)


def load_all() -> None:
    """Import every module; importing registers its queries."""
    for name in MODULES:
        import_module(f"karvan.plans.{name}")
