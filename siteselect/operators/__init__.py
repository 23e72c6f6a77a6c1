"""Table operators: grids, joins, features, ranks and scores, selection, statistics, evaluation, data quality."""
