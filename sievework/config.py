"""Settings of a run, told by the operators themselves.

A run has stages, and a stage is a function. What can be set are the function's keyword arguments that have a default; their
annotations say how text is read, and their defaults hold where nothing is set. Settings are layers of {stage: {option: value}}, the later
over the earlier, option by option. A stage is on unless it is set to false.
"""

from __future__ import annotations

import inspect
import json
import types
import typing
from collections.abc import Callable, Iterable, Mapping
from typing import Any, Union, get_args, get_origin

Stages = Mapping[str, Callable]
Layer = Mapping[str, Union[Mapping[str, Any], bool]]

#: Kinds of values that a file or a command can hold.
PLAIN = (bool, int, float, str, type(None))


def kinds(annotation: Any) -> tuple:
    """The alternatives of an annotation."""
    return get_args(annotation) if get_origin(annotation) in (Union, types.UnionType) else (annotation,)


def is_settable(annotation: Any) -> bool:
    return any(k in PLAIN[:-1] or get_origin(k) in (dict, tuple, list) for k in kinds(annotation))


def options(stage: Callable) -> dict[str, tuple[Any, Any]]:
    """name -> (annotation, default) of what can be set."""
    hints = typing.get_type_hints(stage)
    found = {}
    for p in inspect.signature(stage).parameters.values():
        kind = hints.get(p.name, str)
        if p.default is not p.empty and p.kind in (p.KEYWORD_ONLY, p.POSITIONAL_OR_KEYWORD) and is_settable(kind):
            found[p.name] = kind, p.default
    return found


def read_as(kind: Any, text: str) -> Any:
    """The text as a value of the kind; dictionaries and sequences are written as JSON."""
    if kind is type(None):
        if text not in ("null", "none"):
            raise ValueError(text)
        return None
    if kind is bool:
        return {"true": True, "false": False}[text]
    if get_origin(kind) in (dict, tuple, list):
        return get_origin(kind)(json.loads(text))
    return kind(text)


def value_of(name: str, annotation: Any, given: Any) -> Any:
    """What is given, if it is of the annotation's kind; text is read as the first alternative that it fits, numbers before text."""
    order = sorted(kinds(annotation), key=lambda k: (k is not type(None), k is str))
    for kind in order:
        plain = get_origin(kind) or kind
        if not isinstance(given, str):
            if isinstance(given, plain) and not (isinstance(given, bool) and plain is not bool):
                return given
            if plain is float and type(given) is int or plain is tuple and isinstance(given, list):
                return plain(given)
            continue
        try:
            return read_as(kind, given)
        except (ValueError, KeyError):
            continue
    raise ValueError(f"{name} can't be {given!r}")


def settings(stages: Stages, layers: Iterable[Layer] = (), texts: Iterable[str] = ()) -> dict[str, dict[str, Any]]:
    """stage -> option -> value for every stage that is on. texts: "stage.option=value" or "stage=false", over all layers."""
    layers = list(layers)
    for text in texts:
        name, sign, value = text.partition("=")
        stage, _, option = name.partition(".")
        if not sign:
            raise ValueError(f"not of the form stage.option=value: {text!r}")
        layers.append({stage: {option: value} if option else read_as(bool, value)})
    if strange := {s for layer in layers for s in layer} - set(stages):
        raise LookupError(f"no stage {', '.join(sorted(strange))}; there are {', '.join(stages)}")
    found = {}
    for stage, f in stages.items():
        known, on = options(f), True
        here = {k: default for k, (_, default) in known.items()}
        for given in (layer[stage] for layer in layers if stage in layer):
            on = given is not False
            for k, v in given.items() if isinstance(given, Mapping) else ():
                if k not in known:
                    raise LookupError(f"{stage} has no option {k}; there are {', '.join(known)}")
                here[k] = value_of(f"{stage}.{k}", known[k][0], v)
        if on:
            found[stage] = here
    return found


def layer_of(path: str) -> Layer:
    """A layer from a file of JSON, or of YAML where that can be read."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}
