"""Configurations on the driver: literals, precedence, flattening, signatures and specifications of splits and clusters."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path
from typing import Any

LAYERS = ("portable", "engine", "run")


def literal(text: str) -> Any:
    """`true`, `none`, numbers and quoted text as values; anything else stays text."""
    word = text.strip()
    named = {"true": True, "false": False, "none": None, "null": None, "~": None}
    if word.lower() in named:
        return named[word.lower()]
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word[1:-1] if len(word) > 1 and word[0] == word[-1] and word[0] in "\"'" else word


def simple_yaml(text: str) -> dict:
    """Nested mappings by indentation and inline lists: all that experiment files use."""
    root: dict = {}
    levels = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        key, mark, value = body.strip().partition(":")
        if not mark:
            raise ValueError(f"not a mapping: {line!r}")
        while levels[-1][0] >= indent:
            levels.pop()
        value = value.strip()
        if not value:
            child: dict = {}
            levels[-1][1][key] = child
            levels.append((indent, child))
        elif value.startswith("[") and value.endswith("]"):
            levels[-1][1][key] = [literal(v) for v in value[1:-1].split(",") if v.strip()]
        else:
            levels[-1][1][key] = literal(value)
    return root


def merge(portable: dict, engine: dict | None = None, run: dict | None = None) -> tuple[dict, dict]:
    """(values, where each came from): run values over the engine's own over the portable file's. None inherits; an empty list stands."""
    values, origin = {}, {}
    for layer, source in zip(LAYERS, (portable, engine or {}, run or {}), strict=True):
        for k, v in source.items():
            if v is not None:
                values[k], origin[k] = v, layer
    return values, origin


def flatten(config: dict, prefix: str = "") -> dict[str, Any]:
    """Nested keys joined by dots."""
    out: dict[str, Any] = {}
    for k, v in config.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) and v else {f"{prefix}{k}": v}
    return out


def signature(config: Any, digits: int = 16) -> str:
    """Digest of the canonical JSON: equal for equal contents whatever the order of keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:digits]


def write_json(path: str | Path, content: Any) -> None:
    """Written aside and moved into place, so readers see all of it or none."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_name(f".{path.name}.{os.getpid()}")
    aside.write_text(json.dumps(content, indent=2, sort_keys=True, default=str))
    os.replace(aside, path)


def find_csv(path: str | Path, name: str | None = None) -> Path:
    """A file itself, else the named CSV of a folder, else its only one."""
    path = Path(path)
    if path.is_file():
        return path
    found = sorted(path.glob("*.csv"))
    named = [p for p in found if name and p.stem.lower() == name.lower()]
    if len(named or found) != 1:
        raise FileNotFoundError(f"{path}: no single CSV")
    return (named or found)[0]


def save_specs(path: str | Path, group: str, specs: dict) -> None:
    """One group of a versioned file of specifications; the others stay."""
    path = Path(path)
    content = json.loads(path.read_text()) if path.exists() else {"version": 1, "groups": {}}
    content["groups"][group] = specs
    write_json(path, content)


def load_specs(path: str | Path, group: str, series: int, dates: int) -> dict:
    """Checked split specifications {name: {series, lo, hi}}: within bounds, and no series and date owned twice."""
    specs = json.loads(Path(path).read_text())["groups"][group]
    for name, s in specs.items():
        if not 0 <= s["lo"] < s["hi"] <= dates or min(s["series"]) < 0 or max(s["series"]) >= series or len(set(s["series"])) != len(s["series"]):
            raise ValueError(f"split {name} is out of bounds")
    items = list(specs.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if x["lo"] < y["hi"] and y["lo"] < x["hi"] and set(x["series"]) & set(y["series"]):
                raise ValueError(f"splits {a} and {b} overlap")
    return specs


SUBSET_MODES = ("dates", "individuals", "all")


def save_subset(path: str | Path, split: str, mode: str, indices: list[int], stride: int, series: int, dates: int, group: str = "default", metadata: dict | None = None) -> None:
    """A subset of a split's queries, anchored at query dates; other subsets of the file stay. Without metadata it counts as provided, not drawn."""
    if mode not in SUBSET_MODES:
        raise ValueError(f"no such mode: {mode}")
    path = Path(path)
    content = json.loads(path.read_text()) if path.exists() else {"version": 3, "kind": "subset_specs", "groups": {}}
    if content.get("kind") != "subset_specs":
        raise ValueError(f"{path} has no subsets")
    held = metadata or {"creation_mode": "precomputed", "access_mode": "provided", "randomized": False}
    content["groups"].setdefault(group, {})[split] = {"metadata": held, "mode": mode, "indices": [int(i) for i in indices], "stride": int(stride), "individuals": int(series), "valid_dates": int(dates), "date_anchor": "query_t"}
    write_json(path, content)


def load_subset(path: str | Path, split: str, series: int, dates: int, group: str = "default") -> dict:
    """Mode, indices, stride and metadata of a saved subset, made for a panel of just this size and anchored at query dates. An index beyond its axis, or twice, fails."""
    content = json.loads(Path(path).read_text())
    if content.get("kind") != "subset_specs":
        raise ValueError(f"{path} has no subsets")
    try:
        spec = content["groups"][group][split]
    except KeyError as e:
        raise KeyError(f"{path} has no subset {group}/{split}") from e
    if spec.get("date_anchor") != "query_t":
        raise ValueError("the subset isn't anchored at query dates; make it again")
    if (spec["individuals"], spec["valid_dates"]) != (series, dates):
        raise ValueError(f"the subset is of {spec['individuals']} series and {spec['valid_dates']} dates, not {series} and {dates}")
    end = {"dates": dates, "individuals": series, "all": series * dates}[spec["mode"]]
    if len(set(spec["indices"])) != len(spec["indices"]) or not all(0 <= i < end for i in spec["indices"]):
        raise ValueError("indices are out of bounds or repeated")
    return {k: spec[k] for k in ("mode", "indices", "stride", "metadata")}


def save_clusters(path: str | Path, group: str, clusters: dict[int, list[int]], metadata: dict) -> None:
    """Clusters of series with how they came about."""
    save_specs(path, group, {str(k): sorted(v) for k, v in clusters.items()})
    path = Path(path)
    content = json.loads(path.read_text())
    content.setdefault("metadata", {})[group] = metadata
    write_json(path, content)


def load_clusters(path: str | Path, group: str, series: int) -> dict[int, int]:
    """{series: cluster}; overlapping clusters fail, unassigned series are -1."""
    out = dict.fromkeys(range(series), -1)
    for k, members in json.loads(Path(path).read_text())["groups"][group].items():
        for m in members:
            if out.get(m, None) != -1:
                raise ValueError(f"series {m} is unknown or in two clusters")
            out[m] = int(k)
    return out


def sampling_for(split: str, config: dict) -> dict:
    """Settings that start with train_ for the split `train`, with eval_ for any other."""
    prefix = "train_" if split == "train" else "eval_"
    return {k.removeprefix(prefix): v for k, v in config.items() if k.startswith(prefix)}
