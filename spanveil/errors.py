"""What can go wrong, by stable code."""


class SpanveilError(Exception):
    code = "ERROR"


class InvalidConfig(SpanveilError, ValueError):
    code = "INVALID_CONFIG"


class UnknownLabel(InvalidConfig):
    code = "UNKNOWN_LABEL"


class InvalidSpan(SpanveilError, ValueError):
    code = "INVALID_SPAN"


class SessionNotFound(SpanveilError, KeyError):
    code = "SESSION_NOT_FOUND"


class UnknownPlaceholder(SpanveilError):
    code = "UNKNOWN_PLACEHOLDER"


class ForeignPlaceholder(SpanveilError):
    code = "FOREIGN_PLACEHOLDER"


class IncompletePredictions(SpanveilError):
    code = "INCOMPLETE_PREDICTIONS"


class ChangedFile(SpanveilError):
    code = "CHANGED_FILE"


class InputTooLarge(SpanveilError):
    code = "INPUT_TOO_LARGE"


class ModelUnavailable(SpanveilError):
    code = "MODEL_UNAVAILABLE"
