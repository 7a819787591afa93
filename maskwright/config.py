"""Settings of a run in layers (user's settings, then the project's, then the call's), their checks, and the arguments of the command line."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

from .operators.inputs import ARCHIVES, EXTENSIONS
from .sources.bundles import resolve
from .sources.presets import PRESETS

#: Formats that may be forced by name.
FORMATS = tuple(dict.fromkeys([*EXTENSIONS.values(), "text"]))
MAX_DEPTH = 10


class ConfigError(ValueError):
    """A setting that cannot be used; its text names the setting, never a value that could be secret."""


@dataclass(frozen=True)
class Settings:
    """What a run does. Lists of layers are joined, flags can only be switched on, numbers and texts hold where the call leaves the default."""

    inputs: tuple[str, ...] = ()
    output: str | None = None
    rules: str | None = None
    overlay: tuple[str, ...] = ()
    quick: tuple[str, ...] = ()
    apps: tuple[str, ...] = ()
    preset: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    filters: Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    format: str | None = None
    report: str | None = None
    findings: str | None = None
    depth: int = 5
    max_locations: int = 500
    capacity: int = 10_000_000
    dry_run: bool = False
    strict: bool = False
    hidden: bool = False
    fail_on_match: bool = False
    deterministic: bool = False
    drawn_lengths: bool = False
    no_baseline: bool = False

    def check(self, exists: Callable[[str], bool] = os.path.exists) -> Settings:
        """The settings themselves if they can be used; else ConfigError."""
        if not 1 <= self.depth <= MAX_DEPTH:
            raise ConfigError(f"depth must be from 1 to {MAX_DEPTH}")
        if self.format is not None and self.format not in FORMATS:
            raise ConfigError(f"unknown format; there are {', '.join(FORMATS)}")
        if self.preset is not None and self.preset not in PRESETS:
            raise ConfigError(f"unknown preset; there are {', '.join(PRESETS)}")
        if self.max_locations < 0 or self.capacity < 1:
            raise ConfigError("max_locations and capacity must not be negative")
        if sum(i == "-" for i in self.inputs) > 1:
            raise ConfigError("standard input can be read once")
        if self.dry_run and self.output is not None:
            raise ConfigError("a dry run has no output")
        for k, path in enumerate(self.inputs):
            if path != "-" and "://" not in path and not exists(path):
                raise ConfigError(f"input {k + 1} does not exist")
        for path in self.filters:
            if not path.lower().endswith(tuple("." + a for a in ARCHIVES)):
                raise ConfigError("a filter needs an archive before it")
        resolve(self.apps)
        return self


#: Settings that hold paths, which a file's own folder is the base of.
_PATHS = ("inputs", "output", "rules", "overlay", "report", "findings")


def parse(text: str, name: str) -> dict:
    """A settings file in YAML, JSON or TOML as a dictionary with underscores in its keys."""
    if name.endswith(".toml"):
        data = tomllib.loads(text)
    elif name.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ConfigError("a settings file holds names and values")
    data = {str(k).replace("-", "_"): v for k, v in data.items()}
    if unknown := sorted(set(data) - {f.name for f in fields(Settings)}):
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    return data


def rooted(layer: Mapping, folder: str) -> dict:
    """A layer with its relative paths under the folder of its file."""
    put = lambda p: p if p == "-" or "://" in p or os.path.isabs(p) else os.path.join(folder, p)
    return {k: ([put(p) for p in v] if isinstance(v, (list, tuple)) else put(v)) if k in _PATHS and v else v for k, v in layer.items()}


def merged(call: Settings, *layers: Mapping) -> Settings:
    """The call's settings over the layers, the first of which is the weakest."""
    base, out = Settings(), {}
    for f in fields(Settings):
        given, plain = getattr(call, f.name), getattr(base, f.name)
        found = [layer[f.name] for layer in layers if f.name in layer]
        if isinstance(plain, tuple):
            out[f.name] = tuple(dict.fromkeys(x for part in (*found, given) for x in ([part] if isinstance(part, str) else part)))
        elif isinstance(plain, bool):
            out[f.name] = given or any(bool(x) for x in found)
        elif isinstance(plain, dict):
            out[f.name] = {k: v for part in (*found, given) for k, v in part.items()}
        else:
            out[f.name] = given if given != plain or not found else found[-1]
    return replace(call, **out)


def arguments(argv: Sequence[str]) -> Settings:
    """Settings from the words of a command line: --name value, --flag, and inputs.

    --only and --exclude behind an archive are filters of its entries, --only
    before any input is an error; elsewhere --include and --exclude select files.
    """
    kinds = {f.name: getattr(Settings(), f.name) for f in fields(Settings)}
    names = {"app": "apps", "secrets": "rules", "literal": "quick", **{k: k for k in kinds if k not in ("inputs", "filters")}}
    got: dict = {}
    filters: dict[str, tuple[list[str], list[str]]] = {}
    archive, words = None, list(argv)
    while words:
        word = words.pop(0)
        if not word.startswith("--"):
            got.setdefault("inputs", []).append(word)
            archive = word if word.lower().endswith(tuple("." + a for a in ARCHIVES)) else None
            continue
        flag, eq, value = word[2:].partition("=")
        flag = flag.replace("-", "_")
        if flag == "only" or flag == "exclude" and archive is not None:
            if archive is None:
                raise ConfigError("--only needs an archive before it")
            if not eq and not words:
                raise ConfigError(f"--{flag} needs a value")
            filters.setdefault(archive, ([], []))[flag == "exclude"].extend((value if eq else words.pop(0)).split(","))
            continue
        name = names.get(flag)
        if name is None:
            raise ConfigError(f"unknown argument --{flag.replace('_', '-')}")
        if isinstance(kinds[name], bool):
            got[name] = True
            continue
        if not eq and not words:
            raise ConfigError(f"--{flag} needs a value")
        value = value if eq else words.pop(0)
        if isinstance(kinds[name], int):
            if not re.fullmatch(r"\d+", value):
                raise ConfigError(f"--{flag} needs a number")
            got[name] = int(value)
        elif isinstance(kinds[name], tuple):
            got.setdefault(name, []).append(value)
        else:
            got[name] = value
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()}, filters={k: (tuple(a), tuple(b)) for k, (a, b) in filters.items()})
