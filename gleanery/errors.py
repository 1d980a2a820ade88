"""One error class with stable codes; raised while a plan is built."""


class GleaneryError(ValueError):
    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.details = code, details


def check_range(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise GleaneryError("INVALID_ARGUMENT", f"{name} must be an integer from {low} to {high}", value=value)
    return value


def check_metric(metric: str, *more: str) -> str:
    if metric not in ("cosine", "l2", *more):
        raise GleaneryError("INVALID_METRIC", "metric must be cosine or l2", value=metric)
    return metric


def check_one_of(name: str, value: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise GleaneryError("INVALID_ARGUMENT", f"{name} must be one of {', '.join(known)}", value=value)
    return value
