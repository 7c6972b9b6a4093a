"""Errors of the public interface."""


class InvalidParams(ValueError):
    """Store parameters that don't fit each other."""


class InvalidTime(ValueError):
    """A time or time range that has no place on the axis."""


class InvalidFields(ValueError):
    """A field path or pattern that is empty or has an empty element (or, in a measurement, a wildcard)."""


class ReadOnly(Exception):
    """A store that was opened for reading only can't be written to."""
