"""DataFrame operators: dedup, groups, ranking, sets, neighbours, effects, profiles, regression."""
