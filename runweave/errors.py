"""Errors a user of the package can act on."""


class RunweaveError(Exception):
    """Base of all errors raised here."""


class MissingRuns(RunweaveError):
    """No run, or no iteration of a run, was found."""


class MissingEvent(RunweaveError):
    """A metric needs a trace event that no scanned run has."""


class MissingConfig(RunweaveError):
    """A metric needs a setting (a task list, an energy model) that is not given."""


class EmptyMetric(RunweaveError):
    """A metric gave no row for any iteration."""
