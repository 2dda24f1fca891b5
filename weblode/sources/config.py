"""Typed configuration from environment variables and an optional ``.env`` file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Defaults of a deployment; each field is overridden by the upper-case variable of its name."""

    request_timeout: int = 30
    max_concurrent_requests: int = 10
    default_crawl_depth: int = 2
    max_crawl_depth: int = 10
    max_pages_to_scan: int = 500
    requests_per_second: float = 2.0
    user_agent: str = "Mozilla/5.0 (compatible; weblode)"
    scan_history_limit: int = 20
    log_level: str = "INFO"
    default_download_dir: str = "./downloads"
    max_file_size_mb: int = 100
    mongodb_uri: str = "mongodb://localhost:27017"
    mongodb_database: str = "documents"
    ai_api_url: str = ""
    ai_api_key: str = ""
    ai_model: str = ""
    stirling_pdf_url: str = "http://localhost:8080"


def load_config(env_file: str | None = None, environ: dict[str, str] | None = None) -> Config:
    values: dict[str, str] = {}
    if env_file and Path(env_file).exists():
        for line in Path(env_file).read_text().splitlines():
            name, found, value = line.partition("=")
            if found and not name.lstrip().startswith("#"):
                values[name.strip()] = value.strip().strip("\"'")
    values.update(os.environ if environ is None else environ)
    chosen = {f.name: values[f.name.upper()] for f in fields(Config) if f.name.upper() in values}
    kinds = {"int": int, "float": float, "str": str}
    return Config(**{f.name: kinds[f.type](chosen[f.name]) for f in fields(Config) if f.name in chosen})
