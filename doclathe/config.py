"""Settings from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Defaults; each is read from the environment under its name in upper case."""

    llm_provider: str = "openai"
    llm_api_key: str = ""
    llm_api_base: str = ""
    llm_model: str = ""
    max_batch_size: int = 100
    max_retries: int = 3
    retry_interval: int = 5
    recheck_threshold: float = 0.6
    log_level: str = "INFO"
    log_dir: str = "logs"

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        out = {}
        for f in fields(cls):
            if (v := env.get(f.name.upper())) is not None:
                out[f.name] = type(f.default)(v)
        return cls(**out)
