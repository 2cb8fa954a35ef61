"""DataFrame to DataFrame operators on ruptures, grids, points and distributions."""
