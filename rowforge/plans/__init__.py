"""Registered queries by area."""


def registered():
    from rowforge.plans import catalog, configs, core, formats, intake, operations, streams, transfer  # noqa: F401

    return dict(catalog.QUERIES), dict(catalog.ORACLES)
