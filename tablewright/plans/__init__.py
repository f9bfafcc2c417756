"""Building blocks shared by operators: quantiles, row positions, rule evaluation."""
