"""Readers and writers for tables, features, rasters as pixels, registry reports and decision documents."""
