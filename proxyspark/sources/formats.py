"""Log format registry. A format is data, not code: aliases and delimiters."""

from dataclasses import dataclass, field

from proxyspark import fixed


@dataclass(frozen=True)
class LogFormat:
    """A delimited log whose header row names the columns."""

    name: str
    aliases: dict[str, list[str]] = field(default_factory=dict)
    min_known: int = fixed.MIN_KNOWN_HEADERS

    @property
    def known_names(self) -> list[str]:
        return [a for spellings in self.aliases.values() for a in spellings]


_REGISTRY: list[LogFormat] = []


def register(log_format: LogFormat) -> None:
    """Add a format; earlier ones win when several match a header."""
    if any(f.name == log_format.name for f in _REGISTRY):
        raise ValueError(f"format {log_format.name!r} is already registered")
    _REGISTRY.append(log_format)


def formats() -> list[LogFormat]:
    return list(_REGISTRY)


def by_name(name: str) -> LogFormat | None:
    return next((f for f in _REGISTRY if f.name == name), None)


register(LogFormat("nss_web", fixed.FIELD_ALIASES))
