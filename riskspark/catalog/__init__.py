"""Query catalog: every operator on the driver's tables, with its SQL twin."""

from riskspark.catalog.common import ORACLES, QUERIES


def load():
    """Import all query modules; they register themselves."""
    from riskspark.catalog import governance, graph, scan, streams, text  # noqa: F401

    return QUERIES, ORACLES
