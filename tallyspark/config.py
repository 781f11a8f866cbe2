"""Experiment configurations: a table of rules, each about one path. All broken rules are reported together."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

_ABSENT = object()


@dataclass(frozen=True)
class Rule:
    path: str
    wanted: str
    holds: Callable[[object, dict], bool]
    optional: bool = False

    def broken(self, config: dict) -> Iterator[str]:
        value = look_up(config, self.path)
        if value is _ABSENT:
            if not self.optional:
                yield f"{self.path} is not set; it takes {self.wanted}"
        elif not self.holds(value, config):
            yield f"{self.path} takes {self.wanted}, not {value!r}"


def look_up(config: object, path: str) -> object:
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return _ABSENT
        config = config[key]
    return config


def _whole(low: int, high: float = math.inf):
    return lambda x, _: isinstance(x, int) and not isinstance(x, bool) and low <= x <= high


def _real(low: float, high: float, open_low: bool):
    def holds(x: object, _: dict) -> bool:
        fine = isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
        return fine and (low < x if open_low else low <= x) and x <= high

    return holds


def _one_of(*values):
    return lambda x, _: x in values


def _strings(least: int = 0):
    return lambda x, _: isinstance(x, list) and len(x) >= least and all(isinstance(s, str) for s in x)


def _mapping(least: int = 0):
    return lambda x, _: isinstance(x, dict) and len(x) >= least


def _present(x: object, _: dict) -> bool:
    return x is not None


def _experts(x: object, config: dict) -> bool:
    known = look_up(config, "model.hyperparameters.experts")
    return isinstance(x, list) and isinstance(known, dict) and set(x) <= set(known)


# The paths, their ranges and what may be left out are the configuration's format.
RULES = (
    Rule("seed", "a whole number from 0 to 4294967295", _whole(0, (1 << 32) - 1)),
    Rule("experiment.name", "the name of one folder", lambda x, _: isinstance(x, str) and re.fullmatch(r"(?!\.{1,2}\Z)[^/\\:]+", x) is not None),
    Rule("data.consumer_file", "a path", _present),
    Rule("data.transactions_dir", "a path", _present),
    Rule("features.feature_sets", "a list of at least one set's name", _strings(1)),
    Rule("features.extra_features", "a list of features or nothing", lambda x, c: x is None or _strings()(x, c), True),
    Rule("model.name", "a model's name", _present),
    Rule("model.hyperparameters.router", "the router's parameters", _mapping()),
    Rule("model.hyperparameters.experts", "at least one client's parameters", _mapping(1)),
    Rule("model.training", "a mapping", _mapping(), True),
    Rule("model.training.min_expert_rows", "a whole number above 0", _whole(1), True),
    Rule("model.training.smote_k_neighbors", "a whole number above 0", _whole(1), True),
    Rule("model.training.downsample_negative_keep_ratio", "a number above 0 and up to 1", _real(0, 1, True), True),
    Rule("model.training.smote_positive_multiplier", "a finite number from 1", _real(1, math.inf, False), True),
    Rule("model.training.downsample_negative_clients", "a list of clients with an expert", _experts, True),
    Rule("model.training.smote_positive_clients", "a list of clients with an expert", _experts, True),
    Rule("model.training.sample_weight", "true or false", lambda x, _: isinstance(x, bool), True),
    Rule("runtime", "a mapping", _mapping(), True),
    Rule("runtime.n_jobs", "a whole number above 0", _whole(1), True),
    Rule("split", "a mapping", _mapping(), True),
    Rule("split.name", "per_client_stratified_622", _one_of("per_client_stratified_622"), True),
    Rule("evaluation.name", "an evaluator's name", _present),
    Rule("evaluation.permutation_split", "validation or test", _one_of("validation", "test"), True),
    Rule("evaluation.permutation_features", "all, or a list of features", lambda x, c: x == "all" or _strings()(x, c), True),
    Rule("evaluation.permutation_n_repeats", "a whole number above 0", _whole(1), True),
)


def problems(config: object) -> list[str]:
    """What a run couldn't use, one line for each broken rule."""
    if not isinstance(config, dict):
        return [f"a configuration is a mapping of sections, not {type(config).__name__}"]
    return [line for rule in RULES for line in rule.broken(config)]


def validate_config(config: object) -> None:
    found = problems(config)
    if found:
        raise ValueError("unusable configuration: " + "; ".join(found))


def load_config(path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f)
    validate_config(config)
    return config
