"""Registered queries over the given tables, each with its SQL check where one exists."""


def load_all() -> None:
    """Import every module that registers queries."""
    from boxlake.plans import curation_queries, detection_queries, metric_queries, source_queries  # noqa: F401
