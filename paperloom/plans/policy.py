"""Which addresses may be ingested directly."""

from __future__ import annotations

import re
from urllib.parse import SplitResult, urlsplit

from paperloom.operators.search import InvalidRequest


class DirectPolicy:
    """Trusted address prefixes by source, each given as `source=https://host/path`. An address is allowed if it is https
    without user, has the prefix's host and port, and its path is the prefix's or below it at a boundary."""

    def __init__(self, entries: tuple[str, ...] = ()) -> None:
        self.entries = [self._entry(e) for e in entries if e.strip()]

    @staticmethod
    def _entry(text: str) -> tuple[str, SplitResult]:
        source, mark, prefix = text.strip().partition("=")
        at = urlsplit(prefix.strip())
        if not mark or not source.strip():
            raise InvalidRequest(f"not a trusted prefix: {text!r}")
        if at.scheme.lower() != "https" or not at.hostname:
            raise InvalidRequest(f"a trusted prefix must be https: {text!r}")
        if at.username is not None or at.password is not None:
            raise InvalidRequest("a trusted prefix must not have a user")
        if at.path in ("", "/"):
            raise InvalidRequest("a trusted prefix must not be a whole site")
        return source.strip(), at

    def allows(self, source: str, address: str) -> bool:
        try:
            at = urlsplit(address.strip())
            port = at.port or 443
        except ValueError:
            return False
        if at.scheme.lower() != "https" or not at.hostname or at.username is not None or at.password is not None:
            return False
        if re.search(r"(?i)(/|%2f)(\.|%2e){1,2}(/|%2f|\Z)", at.path):
            return False
        for own, prefix in self.entries:
            below = at.path == prefix.path or at.path.startswith(prefix.path.rstrip("/") + "/")
            if own == source and prefix.hostname == at.hostname and (prefix.port or 443) == port and below:
                return True
        return False
