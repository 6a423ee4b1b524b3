"""Queries over the star-schema tables, which stand in for maps; importing this package registers them."""

from calorgrid.plans import areas, audits, choices, layout, lines, network, plane, records  # noqa: F401
