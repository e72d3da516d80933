"""Reading run directories and side files, writing datasets, checks of what was read."""
