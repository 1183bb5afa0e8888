"""Settings files of `key=value` lines."""

from __future__ import annotations

from pathlib import Path


def load(path: str) -> dict[str, str]:
    """Blank lines, comments (#, !) and lines without a sign of equality are skipped; the last value of a key counts."""
    lines = (x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
    return {k.strip(): v.strip() for k, eq, v in (x.partition("=") for x in lines if x[:1] not in ("", "#", "!")) if eq}
