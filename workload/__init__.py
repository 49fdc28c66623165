"""Queries over the driver tables."""


def _load():
    from workload import registry
    from workload import (  # noqa: F401
        assay_queries, evidence_queries, exposure_queries, quality_queries, screening_queries,
        source_queries, stage_queries, statistics_queries,
    )

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
