"""Plugins: what a package adds, said in one declaration, found by entry points or read from a file.

A plugin that can't be loaded, or says something that is not allowed, does not stop the
others: discovery returns what failed, with the reason. Registering imports nothing;
a component is imported when it is first asked for.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans.catalog import Registry
from tracelake.schema import register_message_type

#: Entry points that name plugins, and the variable that turns discovery off.
GROUP, DISABLE = "tracelake.plugins", "TRACELAKE_DISABLE_PLUGINS"
#: What components can be: operators (DataFrame -> DataFrame), sources, extractors, queries.
KINDS = ("operators", "sources", "extractors", "queries")
_NAMESPACE, _COMPONENT, _PLACE = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z0-9_.]+"), re.compile(r"[A-Za-z_][\w.]*:[A-Za-z_][\w.]*")


@dataclass(frozen=True)
class Plugin:
    """What a package adds: components by kind and name, and message types with their fields."""

    namespace: str
    version: str
    description: str = ""
    author: str | None = None
    components: dict[str, dict[str, str]] = field(default_factory=dict)
    messages: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not _NAMESPACE.fullmatch(self.namespace):
            raise ValueError(f"namespace {self.namespace!r} may have letters, digits, _ and - only")
        if not self.version:
            raise ValueError(f"plugin {self.namespace} has no version")
        for kind, named in self.components.items():
            if kind not in KINDS:
                raise ValueError(f"{self.namespace} has components of kind {kind!r}; there are {', '.join(KINDS)}")
            for name, place in named.items():
                if not _COMPONENT.fullmatch(name):
                    raise ValueError(f"component {name!r} of {self.namespace} may have letters, digits, _ and . only")
                if not _PLACE.fullmatch(place):
                    raise ValueError(f"component {name} of {self.namespace} is at {place!r}, not at module:attribute")

    @staticmethod
    def of(said: dict) -> Plugin:
        """From a mapping; unknown fields are an error, white space at the ends of texts goes."""
        unknown = set(said) - set(Plugin.__dataclass_fields__)
        if unknown:
            raise ValueError(f"a plugin has no {', '.join(sorted(unknown))}")
        missing = {"namespace", "version"} - set(said)
        if missing:
            raise ValueError(f"a plugin needs {', '.join(sorted(missing))}")
        return Plugin(**{k: v.strip() if isinstance(v, str) else v for k, v in said.items()})

    @staticmethod
    def read(path: str) -> Plugin:
        """From a JSON file."""
        return Plugin.of(json.loads(Path(path).read_text(encoding="utf-8")))

    def names(self, kind: str) -> list[str]:
        return [f"{self.namespace}/{name}" for name in self.components.get(kind, {})]


@dataclass
class Plugins:
    """Registries by kind, the plugins that were taken, and those that failed."""

    registries: dict[str, Registry] = field(default_factory=lambda: {k: Registry() for k in KINDS})
    taken: dict[str, Plugin] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> None:
        """All of a plugin or, where a name is taken or a message type differs, nothing of it."""
        clashes = [f"{kind} {n}" for kind in plugin.components for n in plugin.names(kind) if n in self.registries[kind].paths]
        if clashes:
            raise ValueError(f"{', '.join(clashes)} of {plugin.namespace} are registered")
        for name, fields in plugin.messages.items():
            register_message_type(name, fields)
        for kind, named in plugin.components.items():
            for name, place in named.items():
                self.registries[kind].paths[f"{plugin.namespace}/{name}"] = place
        self.taken[plugin.namespace] = plugin

    def discover(self, group: str = GROUP, *, enabled: bool | None = None) -> Plugins:
        """Register what installed packages declare; DISABLE set to anything but 0 or nothing turns it off, ``enabled`` overrules it."""
        if not (os.environ.get(DISABLE, "0") in ("", "0") if enabled is None else enabled):
            return self
        for entry in sorted(metadata.entry_points(group=group), key=lambda e: e.name):
            try:
                said = entry.load()
                said = said() if callable(said) and not isinstance(said, Plugin) else said
                self.register(said if isinstance(said, Plugin) else Plugin.of(said))
            except Exception as e:  # noqa: BLE001  whatever a plugin does on import is its own failure
                self.failed[entry.name] = f"{type(e).__name__}: {e}"
        return self

    def get(self, kind: str, name: str):
        """A component, imported now if it was not before."""
        return self.registries[kind].get(name)

    def listing(self, spark: SparkSession) -> DataFrame:
        """(kind, namespace, name, path, loaded) of all components."""
        out = None
        for kind, registry in self.registries.items():
            rows = registry.listing(spark).selectExpr(f"'{kind}' AS kind", "*")
            out = rows if out is None else out.unionByName(rows)
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """(plugin, version, components, reason): reason is null for plugins that were taken."""
        rows = [(n, p.version, sum(map(len, p.components.values())), None) for n, p in self.taken.items()] + [(n, None, 0, why) for n, why in self.failed.items()]
        return spark.createDataFrame(rows, "plugin string, version string, components int, reason string")
