"""Every operator as a named query, and the checking SQL."""


def _load():
    from pinwatch.catalog import exposure, feeds, reports, streams  # noqa: F401
    from pinwatch.catalog import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_checks():
    return dict(_load().CHECKS)
