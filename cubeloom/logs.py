"""Logging to stderr as text or JSON lines."""

from __future__ import annotations

import json
import logging
import os
import sys

from .errors import ConfigurationError, json_safe

_PLAIN = set(vars(logging.makeLogRecord({})))


def _extras(record: logging.LogRecord) -> dict:
    return {k: v for k, v in vars(record).items() if k not in _PLAIN and k not in ("message", "asctime")}


class TextFormatter(logging.Formatter):
    def __init__(self) -> None:
        super().__init__("%(asctime)s %(levelname)s %(name)s %(message)s")

    def format(self, record: logging.LogRecord) -> str:
        extra = " ".join(f"{k}={v}" for k, v in _extras(record).items())
        return super().format(record) + (f" {extra}" if extra else "")


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()} | _extras(record)
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(json_safe(out), default=str)


def configure(level: str | None = None, form: str | None = None) -> logging.Logger:
    """Set up the package's logger; CUBELOOM_LOG_LEVEL and CUBELOOM_LOG_FORMAT stand in for arguments."""
    level = (level or os.environ.get("CUBELOOM_LOG_LEVEL", "INFO")).upper()
    form = (form or os.environ.get("CUBELOOM_LOG_FORMAT", "text")).lower()
    if level not in logging.getLevelNamesMapping() or form not in ("text", "json"):
        raise ConfigurationError("unknown log level or format", context={"level": level, "format": form})
    logger = logging.getLogger("cubeloom")
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonFormatter() if form == "json" else TextFormatter())
    logger.handlers[:] = [handler]
    logger.setLevel(level)
    logger.propagate = False
    return logger
