"""Readers: maps as GeoJSON, results as GeoJSON, the catalogue as CSV, rules as YAML, and the parts store."""
