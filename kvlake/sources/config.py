"""Server and cluster settings from YAML or JSON, checked field by field."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: Fixed values.
LOG_LEVELS = ("debug", "info", "warn", "error")


class ConfigError(ValueError):
    """A setting that can't stand; the message names it."""


def parse(text: str) -> dict:
    """JSON, or YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("config: not JSON, and no YAML reader is installed") from e
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"config: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError("config: a mapping is expected")
    return found


def _known(found: Mapping, kind: type, where: str = "") -> None:
    names = {f.name for f in fields(kind)}
    for name in found:
        if name not in names:
            raise ConfigError(f"config: field {where}{name} is unknown")


@dataclass(frozen=True)
class ServerConfig:
    """Settings of a server; the defaults are fixed values."""

    listen: str = "127.0.0.1:7654"
    metrics_listen: str = "127.0.0.1:7655"
    data_dir: str = "data"
    memtable_size_mb: int = 4
    log_level: str = "info"
    wal_sync: bool = True


def server_config(text: str | None = None, flags: Mapping[str, object] | None = None) -> ServerConfig:
    """Flags that are set go before the file, the file before the defaults."""
    found = parse(text) if text else {}
    _known(found, ServerConfig)
    config = replace(ServerConfig(), **found)
    given = {k: v for k, v in (flags or {}).items() if v not in (None, "")}
    _known(given, ServerConfig, "-")
    config = replace(config, **given)
    if config.log_level not in LOG_LEVELS:
        raise ConfigError(f"config: unknown log_level {config.log_level!r}")
    return config


@dataclass(frozen=True)
class Node:
    id: int = 0
    raft: str = ""
    client: str = ""


@dataclass(frozen=True)
class ClusterConfig:
    groups: tuple[int, ...] = ()
    nodes: tuple[Node, ...] = ()

    def sorted_groups(self) -> list[int]:
        return sorted(self.groups)

    def peers(self) -> dict[int, str]:
        return {n.id: n.raft for n in self.nodes}

    def settings(self) -> list[tuple[str, str, object]]:
        """(kind, place, value) of each single setting: values of one kind must be set and differ."""
        flat: list[tuple[str, str, object]] = [("group", f"groups[{i}]", g) for i, g in enumerate(self.groups)]
        kinds = {"id": "node", "raft": "address", "client": "address"}
        return flat + [(kind, f"nodes[{i}].{name}", getattr(n, name)) for i, n in enumerate(self.nodes) for name, kind in kinds.items()]

    def faults(self) -> list[str]:
        """All that is wrong, each with its places; empty for settings that can stand."""
        flat = self.settings()
        held: dict[tuple[str, object], list[str]] = {}
        for kind, place, value in flat:
            if value:
                held.setdefault((kind, value), []).append(place)
        lists = {"groups": self.groups, "nodes": self.nodes}
        return [
            *(f"{name}: empty" for name, values in lists.items() if not values),
            *(f"nodes: {n} of them, which two equal halves could split" for n in [len(self.nodes)] if n and n % 2 == 0),
            *(f"{place}: not set" for _, place, value in flat if not value),
            *(f"{', '.join(places)}: one {kind} {value!r} for all" for (kind, value), places in held.items() if len(places) > 1),
        ]


def cluster_config(text: str) -> ClusterConfig:
    """A cluster's settings; an error lists all faults."""
    found = parse(text)
    _known(found, ClusterConfig)
    nodes = found.get("nodes") or []
    for i, n in enumerate(nodes):
        _known(n, Node, f"nodes[{i}].")
    config = ClusterConfig(tuple(found.get("groups") or ()), tuple(Node(**n) for n in nodes))
    if faults := config.faults():
        raise ConfigError("config: " + "; ".join(faults))
    return config
