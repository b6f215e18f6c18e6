"""Errors that operators raise on the driver."""


class RoadMapError(Exception):
    """Base of all errors of this library."""


class NoSuchPrimitiveError(RoadMapError):
    """A lookup by id found nothing."""


class NoSuchAttributeError(RoadMapError):
    """An attribute that was asked for without a default is missing."""


class InvalidInputError(RoadMapError):
    """An argument or a table is outside what the operator is defined for."""


class GeometryError(RoadMapError):
    """A shape does not allow the operation."""


class MapFormatError(RoadMapError):
    """A map file or its references are incomplete; `errors` lists what was found."""

    def __init__(self, errors: list[str]):
        super().__init__("\n".join(errors))
        self.errors = errors


class ProjectionError(RoadMapError):
    """A coordinate cannot be projected."""


class MatchingError(RoadMapError):
    """An object's covariance cannot be used."""


class GraphError(RoadMapError):
    """A routing graph would hold an impossible edge."""
