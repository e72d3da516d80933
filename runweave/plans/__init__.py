"""Whole analyses: the metrics of a trace, datasets across runs, comparisons and the summary."""
