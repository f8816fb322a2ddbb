"""All registered queries and their SQL."""

from tablecraft.catalog import charts, ingest, learning, quality, recipes, rows, streams, transforms

AREAS = (ingest, quality, rows, transforms, recipes, charts, learning, streams)


def queries() -> dict:
    return {name: fn for area in AREAS for name, fn in area.catalog.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.catalog.oracles.items()}
