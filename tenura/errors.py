"""Errors raised by the library. All are ``ValueError``s."""


class SchemaError(ValueError):
    """Required columns are missing or two columns claim one name."""


class InsufficientDataError(ValueError):
    """There are too few rows or months for what was asked."""


class ForecasterError(ValueError):
    """A registered forecaster returned something else than agreed."""


class DateFormatError(ValueError):
    """No date format fits, or more than half of the rows fail to parse."""


class LeakageError(ValueError):
    """Label information reached the features or the training set."""


class ModelError(ValueError):
    """The model cannot be trained or was used before training."""
