"""keepwell: customer-retention analytics as Spark DataFrame operators."""

from keepwell.session import get_session

__all__ = ["get_session"]
