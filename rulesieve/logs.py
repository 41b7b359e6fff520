"""Logging: text or JSON lines, to the error stream and optionally to a file."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        told = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            told["exception"] = self.formatException(record.exc_info)
        return json.dumps(told)


def setup(level: str = "warning", file: str | None = None, form: str = "text") -> logging.Logger:
    log = logging.getLogger("rulesieve")
    log.setLevel(level.upper())
    log.handlers.clear()
    formatter = JsonLines() if form == "json" else logging.Formatter("%(asctime)s %(levelname)-8s %(name)s: %(message)s")
    for handler in [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]:
        handler.setFormatter(formatter)
        log.addHandler(handler)
    return log
