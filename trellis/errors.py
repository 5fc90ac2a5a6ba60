"""Errors of the engine, each with the HTTP status that the gateway answers."""


class TrellisError(Exception):
    """Base of all errors of this package."""

    status = 500


class QuerySyntaxError(TrellisError):
    status = 400


class QueryRejected(TrellisError):
    """The text fails validation before it is parsed."""

    status = 400


class MappingError(TrellisError):
    status = 422


class UnsupportedFeature(TrellisError):
    status = 501


class ServiceError(TrellisError):
    status = 502


def status_of(error: BaseException) -> int:
    """The HTTP status of any error."""
    if isinstance(error, TrellisError):
        return error.status
    return 504 if isinstance(error, TimeoutError) else 500
