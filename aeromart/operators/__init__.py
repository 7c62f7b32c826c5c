"""DataFrame -> DataFrame operators: cleaning, joins, dimensions, facts, marts, slices."""
