"""Errors of the data layer."""


class NoRows(LookupError):
    """A query for one row found none."""


class NotLoaded(RuntimeError):
    """A relation was read that the query did not preload."""


class AffectedMismatch(RuntimeError):
    """A write touched another number of rows than it had to."""


class CommitConflict(RuntimeError):
    """Another commit changed a table that this one read or wrote; the work may be tried again."""


class ConstraintError(ValueError):
    """A write would break a primary or unique key."""


class SchemaDrift(RuntimeError):
    """Model and table differ."""


class ReadOnly(RuntimeError):
    """A write in a read-only transaction."""
