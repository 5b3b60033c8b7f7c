"""Settings from the environment and from ``KEY=VALUE`` files; read when asked, not on import."""

from __future__ import annotations

import os
import re
from pathlib import Path


_PAIR = re.compile(r"^[ \t]*(?P<key>[^#=\s][^=\n]*?)[ \t]*=[ \t]*(?P<value>[^\n]*?)[ \t]*$", re.MULTILINE)


def load_env(path: str = ".env", override: bool = False) -> dict[str, str]:
    """Puts the pairs of a file into the environment; what is set stays unless ``override``. A missing file is no fault."""
    text = Path(path).read_text(encoding="utf-8") if Path(path).exists() else ""
    pairs = {m["key"]: m["value"].strip("\"").strip("'") for m in _PAIR.finditer(text)}
    put = {k: v for k, v in pairs.items() if override or k not in os.environ}
    os.environ.update(put)
    return put


def env_text(name: str, default: str) -> str:
    """A text from the environment; missing or blank gives the default."""
    return os.environ.get(name, "").strip() or default


def service_url() -> str:
    """Address of the chat service (``CUELAKE_SERVICE_URL``), read when asked."""
    return env_text("CUELAKE_SERVICE_URL", "http://localhost:8000/v1").rstrip("/")


def service_model() -> str:
    """Model of the chat service (``CUELAKE_SERVICE_MODEL``)."""
    return env_text("CUELAKE_SERVICE_MODEL", "default")


def env_number(name: str, default: float) -> float:
    """A number from the environment; missing or garbage gives the default."""
    try:
        return float(os.environ.get(name, "").strip())
    except ValueError:
        return default
