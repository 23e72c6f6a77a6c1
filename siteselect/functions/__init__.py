"""Column functions: cleaning (clean) and plane geometry without a geometry type (geo)."""
