"""Settings: defaults, then a YAML file's, then the environment's."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from siltstone.functions.scoring import STRATEGIES, normalize_weights
from siltstone.sources.files import EXTENSIONS, IGNORED_NAMES, IGNORED_PATTERNS

PREFIX = "SILTSTONE_"


@dataclass(frozen=True)
class Config:
    root: str = "~/.siltstone"
    provider: str = "hash"
    base_url: str = ""
    model: str = ""
    dim: int = 1024
    max_lines: int = 120
    overlap: int = 20
    limit: int = 8
    extensions: tuple[str, ...] = EXTENSIONS
    ignored_names: tuple[str, ...] = IGNORED_NAMES
    ignored_patterns: tuple[str, ...] = IGNORED_PATTERNS
    weights: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(STRATEGIES))


def merged(*lists) -> tuple[str, ...]:
    """Trimmed values, each once, in order."""
    return tuple(dict.fromkeys(v.strip() for xs in lists for v in xs if v.strip()))


def override(config: Config, values: dict) -> Config:
    """Known settings with a valid value; numbers that aren't positive and unknown names are left out. A strategy may set one weight of its two."""
    new: dict = {}
    for f in fields(Config):
        v = values.get(f.name)
        if v is None or f.name == "weights":
            continue
        if isinstance(getattr(config, f.name), int):
            try:
                v = int(v)
            except (TypeError, ValueError):
                continue
            if v <= 0 and f.name != "overlap" or v < 0:
                continue
        elif isinstance(getattr(config, f.name), tuple):
            v = merged(getattr(config, f.name) if f.name.startswith("ignored") else (), v if isinstance(v, (list, tuple)) else str(v).split(","))
        new[f.name] = v
    weights = dict(config.weights)
    for name, w in (values.get("weights") or {}).items():
        if name in weights:
            s, k = weights[name]
            weights[name] = normalize_weights(float(w.get("semantic", s)), float(w.get("keyword", k)), STRATEGIES[name])
    out = replace(config, weights=weights, **new)
    return replace(out, overlap=config.overlap if config.overlap < out.max_lines else out.max_lines // 4) if out.overlap >= out.max_lines else out


def from_environment(config: Config, env: dict[str, str] | None = None) -> Config:
    env = dict(os.environ) if env is None else env
    values: dict = {f.name: env[PREFIX + f.name.upper()] for f in fields(Config) if env.get(PREFIX + f.name.upper())}
    weights: dict[str, dict[str, float]] = {}
    for name in STRATEGIES:
        for part in ("semantic", "keyword"):
            raw = env.get(f"{PREFIX}SEARCH_{name.upper()}_{part.upper()}_WEIGHT")
            try:
                if raw is not None:
                    weights.setdefault(name, {})[part] = float(raw)
            except ValueError:
                pass
    return override(config, values | {"weights": weights})


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    config = Config()
    if path and Path(path).exists():
        try:
            import yaml
        except ImportError:  # plain "name: value" lines need no parser
            lines = (x.split("#")[0].rstrip() for x in Path(path).read_text().splitlines())
            config = override(config, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x and not x.startswith(" ")) if v.strip()})
        else:
            config = override(config, yaml.safe_load(Path(path).read_text()) or {})
    return from_environment(config, env)


def write_default(path: str, force: bool = False) -> None:
    """A commented file of the defaults, readable by its owner alone; an existing one stays unless forced."""
    p = Path(path).expanduser()
    if p.exists() and not force:
        raise FileExistsError(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    c = Config()
    p.write_text(f"provider: {c.provider}\nbase_url: {c.base_url!r}\nmodel: {c.model!r}\ndim: {c.dim}\nmax_lines: {c.max_lines}\noverlap: {c.overlap}\nlimit: {c.limit}\n")
    p.chmod(0o600)
