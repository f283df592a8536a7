"""Driver logs to the console and to files that rotate."""

from __future__ import annotations

import logging
import logging.handlers
from pathlib import Path

#: A file's size and how many are kept.
MAX_BYTES, KEPT = 10 * 1024 * 1024, 5


def logger(name: str = "doclathe", folder: str | None = None, level: str = "INFO") -> logging.Logger:
    """Configured once for each name."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(level)
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            handlers.append(logging.handlers.RotatingFileHandler(f"{folder}/{name}.log", maxBytes=MAX_BYTES, backupCount=KEPT, encoding="utf-8"))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            log.addHandler(h)
    return log
