"""Site selection on Spark tables: spatial features, scoring, selection and spatially honest evaluation."""
