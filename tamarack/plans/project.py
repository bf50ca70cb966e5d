"""Project rules and configuration: read from JSON, checked before anything runs."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from tamarack.functions.text import template_parts
from tamarack.plans.corpus import INCLUDE
from tamarack.plans.rules import ProjectRule
from tamarack.plans.selector import QueryError, parse_query
from tamarack.vocab import SELECTOR_KEYS, SEVERITIES

LEVELS = ("error", "warn", "info", "off")
_LISTS = {"patterns": "include", "ignore": "ignore", "ignoreReferences": "ignore_references", "families": "families", "ignoreFamilies": "ignore_families", "historyPatterns": "history"}


class ConfigError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass
class Config:
    include: tuple[str, ...] = INCLUDE
    ignore: tuple[str, ...] = ()
    ignore_references: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    ignore_families: tuple[str, ...] = ()
    history: tuple[str, ...] = ()
    baseline: str | None = None
    ratchet: bool = False
    strict: bool = False
    max_related: int = 8
    severities: dict[str, str] = field(default_factory=dict)
    rules: tuple[ProjectRule, ...] = ()


def compile_rules(raw: Mapping, problems: list[str]) -> tuple[ProjectRule, ...]:
    """Project rules in order of name; what is wrong is added to ``problems``."""
    out = []
    for name in sorted(raw):
        rule, where = raw[name], f'rule "{name}"'
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", name) or not isinstance(rule, Mapping):
            problems.append(f"{where}: a name of letters, digits and ._- and an object are expected")
            continue
        problems += [f"{where}: unknown field {k}" for k in rule if k not in ("query", "message", "hint", "severity")]
        texts = [rule.get("query")] if isinstance(rule.get("query"), str) else rule.get("query")
        if not isinstance(texts, list) or not texts or not all(isinstance(q, str) for q in texts):
            problems.append(f"{where}: query must be a selector or a list of them")
            continue
        queries = []
        for text in texts:
            try:
                queries.append(parse_query(text))
            except QueryError as e:
                problems.append(f"{where}: {e}")
        message, hint, level = rule.get("message", f"matched by {name}"), rule.get("hint", ""), rule.get("severity", "warn")
        if not all(isinstance(x, str) for x in (message, hint)) or level not in LEVELS:
            problems.append(f"{where}: message and hint are text, severity one of {', '.join(LEVELS)}")
            continue
        # A place must be there whichever of the selectors matched.
        shortest = min((len(q.steps) + 1 for q in queries), default=0)
        for text, place, key in template_parts(message) + template_parts(hint):
            if place is not None and place >= shortest:
                problems.append(f"{where}: {text} names no step of every selector")
            if key and not (key.lower().startswith("fm.") or key.lower() in SELECTOR_KEYS):
                problems.append(f"{where}: {text} names no attribute")
        if len(queries) == len(texts):
            out.append(ProjectRule(name, tuple(queries), message, hint, level))
    return tuple(out)


def parse_config(text: str) -> Config:
    """A configuration; an unknown key or a value of the wrong type is an error that lists all problems."""
    problems: list[str] = []
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ConfigError([f"not JSON: {e}"]) from None
    if not isinstance(raw, dict):
        raise ConfigError(["an object is expected"])
    out = Config()
    for key, value in raw.items():
        if key == "$schema":
            continue
        if key in _LISTS:
            if isinstance(value, list) and all(isinstance(x, str) for x in value):
                setattr(out, _LISTS[key], tuple(value))
            else:
                problems.append(f"{key} must be a list of texts")
        elif key in ("ratchet", "strict"):
            setattr(out, key, value) if isinstance(value, bool) else problems.append(f"{key} must be true or false")
        elif key == "baseline":
            setattr(out, key, value) if isinstance(value, str) else problems.append("baseline must be a path")
        elif key == "maxRelated":
            if isinstance(value, int) and not isinstance(value, bool) and value >= 0:
                out.max_related = value
            else:
                problems.append("maxRelated must be a number from 0")
        elif key == "severities":
            if isinstance(value, dict) and all(v in LEVELS for v in value.values()):
                problems += [f"severities: unknown rule {k}" for k in value if k not in SEVERITIES and not k.startswith("project:")]
                out.severities = dict(value)
            else:
                problems.append(f"severities must map rules to {', '.join(LEVELS)}")
        elif key == "rules":
            if isinstance(value, dict):
                out.rules = compile_rules(value, problems)
            else:
                problems.append("rules must be an object")
        else:
            problems.append(f"unknown key {key}")
    both = {f.upper() for f in out.families} & {f.upper() for f in out.ignore_families}
    problems += [f"family {f} is both asked for and ignored" for f in sorted(both)]
    if problems:
        raise ConfigError(problems)
    return out
