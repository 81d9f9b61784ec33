"""Messages of the package: to standard output and, if wanted, a file, as lines or as JSON."""

from __future__ import annotations

import json
import logging
import sys

NAME = "quire"


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)


def configure(level: str = "INFO", as_json: bool = False, file: str | None = None) -> logging.Logger:
    """Sets up the driver's messages anew; an unknown level is an error. Executors' messages are in Spark's own logs."""
    log = logging.getLogger(NAME)
    log.setLevel(level.upper())
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    form = JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    for h in (logging.StreamHandler(sys.stdout), *([logging.FileHandler(file, encoding="utf-8")] if file else [])):
        h.setFormatter(form)
        log.addHandler(h)
    log.propagate = False
    return log
