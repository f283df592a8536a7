"""Plugins: cleaning rules, prompts and parsers, with their state and a configuration file on the driver."""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.cleaning import BUILT_IN, CleanRule

KINDS = ("clean_rule", "prompt", "doc_parser")


@dataclass
class Plugin:
    name: str
    kind: str
    body: object
    version: str = "1.0"
    description: str = ""
    author: str = ""
    enabled: bool = True
    error: str = ""
    config: dict = field(default_factory=dict)

    def info(self) -> dict:
        status = "error" if self.error else "enabled" if self.enabled else "disabled"
        return {"name": self.name, "type": self.kind, "version": self.version, "description": self.description, "author": self.author, "status": status, "error": self.error}


#: Name: system prompt, template, format hint.
PROMPTS = {
    "resume": ("You read CVs.", "List name, contact, education, employment and skills of the CV below as JSON.\n\n{text}", "json"),
    "contract": ("You read contracts.", "List parties, dates, amounts and duties of the contract below as JSON.\n\n{text}", "json"),
    "news": ("You read news.", "List headline, people, places, time and a summary of the article below as JSON.\n\n{text}", "json"),
}


class PluginManager:
    def __init__(self, built_in: bool = True):
        self.plugins: dict[str, Plugin] = {}
        if built_in:
            for r in BUILT_IN:
                self.register(Plugin(r.name, "clean_rule", r, r.version, r.description))
            for k, v in PROMPTS.items():
                self.register(Plugin(k, "prompt", v))
            from .sources.files import CSV_PLUGIN

            self.register(Plugin(CSV_PLUGIN.name, "doc_parser", CSV_PLUGIN))

    def register(self, p: Plugin) -> None:
        if p.kind not in KINDS:
            raise ValueError(f"unknown kind of plugin {p.kind!r}")
        self.plugins[p.name] = p

    def unregister(self, name: str) -> bool:
        return self.plugins.pop(name, None) is not None

    def get(self, name: str) -> Plugin | None:
        return self.plugins.get(name)

    def of_kind(self, kind: str, enabled: bool = True) -> list[Plugin]:
        return [p for p in self.plugins.values() if p.kind == kind and (p.enabled or not enabled)]

    def enable(self, name: str, on: bool = True) -> bool:
        if p := self.plugins.get(name):
            p.enabled, p.error = on, ""
        return name in self.plugins

    def enable_all(self, on: bool = True) -> None:
        for name in self.plugins:
            self.enable(name, on)

    def parser_for_file(self, path: str) -> Plugin | None:
        """The first enabled parser plugin for a file's extension."""
        ext = path.rpartition(".")[2].lower()
        return next((p for p in self.of_kind("doc_parser") if ext in p.body.extensions), None)

    def load(self, class_path: str, **config) -> Plugin:
        """From ``module:attribute`` or ``module.attribute``: a plugin, a cleaning rule, or what makes one."""
        module, _, name = class_path.replace(":", ".").rpartition(".")
        body = getattr(importlib.import_module(module), name)
        body = body(**config) if callable(body) and not isinstance(body, CleanRule) else body
        p = body if isinstance(body, Plugin) else Plugin(body.name, "clean_rule", body)
        p.config = {**config}
        self.register(p)
        return p

    def clean(self, df: DataFrame) -> DataFrame:
        """Folds enabled rules in order of registration; a rule whose plan fails is marked and left out."""
        for p in self.of_kind("clean_rule"):
            try:
                df = p.body(df)
            except Exception as e:
                p.error = f"{type(e).__name__}: {e}"
        return df

    def list_all(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(p.info().values()) for p in self.plugins.values()], "name string, type string, version string, description string, author string, status string, error string")

    def save(self, path: str) -> None:
        own = {p.name: {"enabled": p.enabled, "config": p.config} for p in self.plugins.values()}
        Path(path).write_text(json.dumps({"version": "1.0", "plugins": own}, ensure_ascii=False, indent=2))

    def restore(self, path: str) -> None:
        """Only of plugins that are registered."""
        for name, state in json.loads(Path(path).read_text()).get("plugins", {}).items():
            if p := self.plugins.get(name):
                p.enabled, p.config = state.get("enabled", True), state.get("config", {})
