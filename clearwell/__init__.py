"""Data quality, governance and decision analytics as Spark DataFrame operators."""

from clearwell.session import build_session

__all__ = ["build_session"]
