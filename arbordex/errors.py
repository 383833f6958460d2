"""Failures, one class for each status of the interface."""


class CatalogueError(Exception):
    """Base class; code is the status number."""

    code = 99


class InvalidArgument(CatalogueError):
    code = 1


class StaleResult(CatalogueError):
    """The result's snapshot is gone or one of its rows was removed."""

    code = 2


class VolumeUnavailable(CatalogueError):
    code = 4


class QuerySyntaxError(CatalogueError):
    code = 5


class SnapshotInvalid(CatalogueError):
    code = 6


class CommitConflict(CatalogueError):
    """Another writer changed what this change was made from; make it again from the last version."""

    code = 9


class Cancelled(CatalogueError):
    code = 8


class TopologyError(CatalogueError):
    """A cycle, a missing or non-directory parent, or an object with clashing rows."""

    code = 6


class RescanRequired(TopologyError):
    """A batch, or the journal itself, cannot be followed from the store's cursor; the volume must be scanned anew."""
