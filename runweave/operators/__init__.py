"""Building blocks on DataFrames: ordered work, intervals, distributions, reshaping."""
