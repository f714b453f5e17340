"""Early-warning analytics over event and flow logs, as Spark DataFrame operators."""

from portentia.timeline import Timeline

__all__ = ["Timeline"]
