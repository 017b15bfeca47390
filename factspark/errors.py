"""Errors of transactions and storage."""

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException


#: Failures of Spark, its storage or its connection; no validator's verdict.
ENGINE = (PySparkException, Py4JError, OSError)


class TransactionClosed(RuntimeError):
    """The transaction was committed or rolled back."""


class TransactionConflict(RuntimeError):
    """Another commit came first."""


class ConstraintViolation(ValueError):
    """A validator refused the candidate."""


class LogCorruption(RuntimeError):
    """A file that a manifest names is missing or altered, or the chain of manifests is broken."""


class UnknownTemporary(KeyError):
    """An operation names a temporary entity that its intent didn't allocate."""


class QueueFull(RuntimeError):
    """The ingress holds as many intents as it may; the intent is given back."""


class LeaseTaken(RuntimeError):
    """Another writer holds the lease."""
