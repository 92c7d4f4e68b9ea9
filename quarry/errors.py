"""What goes wrong in the tool layer.

``recoverable`` tells a caller whether the same call may succeed later: what the network
loses may come back, what the request or the project lacks won't.
"""


class QuarryError(Exception):
    recoverable = True


class UnusableInput(QuarryError):
    """The request, the settings or the project can't give an answer."""

    recoverable = False


class ConfigError(UnusableInput):
    pass


class LanguageDetectionError(UnusableInput):
    pass


class SkillNotFoundError(UnusableInput):
    def __init__(self, skill: str, sources: tuple[str, ...] = ()):
        super().__init__(f"no skill named {skill!r}" + (f" in {', '.join(sources)}" if sources else ""))
        self.skill, self.sources = skill, sources


class NetworkError(QuarryError):
    """A request failed; ``status_code`` is the server's, if it answered."""

    status_code: int | None = None

    def __init__(self, *said: object, status_code: int | None = None):
        super().__init__(*said)
        if status_code is not None:
            self.status_code = status_code


class RetryExhaustedError(NetworkError):
    """The last of several tries failed as well, for the reason in ``__cause__``."""

    @classmethod
    def after(cls, tries: int, last: Exception) -> "RetryExhaustedError":
        return cls(f"failed after {tries} attempts: {last}", status_code=getattr(last, "status_code", None))
