"""Parameters users pass as text, checked the same way everywhere."""

import re
from collections.abc import Mapping
from dataclasses import dataclass

from footfall.fixed_values import DEFAULT_LIMIT, MAX_LIMIT, MIN_SALT_LENGTH, RETENTION_DAYS


def parse_limit(raw: str | int | None) -> int:
    if raw is None:
        return DEFAULT_LIMIT
    limit = _integer(raw, "limit")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit out of range: {limit}")
    return limit


def parse_visitors(raw: str | None) -> str | None:
    """None or "engaged"; a mistyped filter must not quietly return everyone."""
    if raw not in (None, "engaged"):
        raise ValueError(f"unknown visitors filter: {raw!r}")
    return raw


def parse_salt(raw: str) -> str:
    if len(raw) < MIN_SALT_LENGTH:
        raise ValueError(f"salt must be at least {MIN_SALT_LENGTH} characters")
    return raw


def parse_retention_days(raw: str | int | None) -> int:
    days = RETENTION_DAYS if raw is None else _integer(raw, "retention days")
    if days <= 0:
        raise ValueError(f"retention days must be positive: {days}")
    return days


def parse_list(raw: str | None) -> list[str]:
    return [part.strip() for part in (raw or "").split(",") if part.strip()]


def parse_log_paths(raw: str | None) -> list[str]:
    paths = parse_list(raw)
    if not paths:
        raise ValueError("log paths name no files")
    return paths


def _integer(raw: str | int, what: str) -> int:
    """Whole numbers only: ASCII digits with an optional sign, or an int."""
    if isinstance(raw, str) and re.fullmatch(r"[+-]?[0-9]+", raw):
        return int(raw)
    if isinstance(raw, int) and not isinstance(raw, bool):
        return raw
    raise ValueError(f"{what} is not a number: {raw!r}")


@dataclass(frozen=True)
class Settings:
    """What one ingest job needs besides its input and lookup tables."""

    salt: str
    internal_proxies: frozenset[str] = frozenset()
    retention_days: int = RETENTION_DAYS

    def __post_init__(self):
        parse_salt(self.salt)
        parse_retention_days(self.retention_days)

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> "Settings":
        if not env.get("IP_HASH_SALT", "").strip():
            raise ValueError("IP_HASH_SALT must be set")
        return cls(
            salt=env["IP_HASH_SALT"],
            internal_proxies=frozenset(parse_list(env.get("INTERNAL_PROXY_IPS"))),
            retention_days=parse_retention_days(env.get("RETENTION_DAYS")),
        )
