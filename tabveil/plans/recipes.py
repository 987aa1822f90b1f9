"""Recipes: saved column configurations, matched to the headers of later files."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from tabveil.functions.names import header_keys, header_signature, normal_header
from tabveil.plans import model

VERSION = 1
MOST_NAME = 100
LEAST_SCORE = 0.5
# The names in saved recipes.
_CAMEL = {"id": "id", "schema_version": "schemaVersion", "header_signature": "headerSignature", "skip_malformed": "skipMalformed", "entity_groups": "entityGroups"}


@dataclass(frozen=True)
class RecipeColumn:
    name: str
    strategy: str
    options: dict = field(default_factory=dict)
    mapping_domain: str | None = None


@dataclass(frozen=True)
class Recipe:
    name: str
    owner: str
    columns: tuple[RecipeColumn, ...]
    entity_groups: tuple[model.EntityGroup, ...] = ()
    skip_malformed: bool = False
    id: str = ""
    created: str = ""
    updated: str = ""
    header_signature: str = ""
    schema_version: int = VERSION


def clean_name(name: str) -> str:
    return name.strip()[:MOST_NAME]


def from_plan(name: str, owner: str, header: list[str], plan: model.Plan, skip_malformed: bool = False) -> Recipe:
    """Date formats are not saved; they belong to a file."""
    columns = []
    for original, key in zip(header, header_keys(header), strict=True):
        rule = plan.columns[key]
        if rule.strategy == "Custom":
            raise model.PlanError([f"Column '{key}': a function of one's own can't be saved in a recipe."])
        options = {k: v for k, v in asdict(rule.options).items() if k != "formats"} if rule.options else {}
        columns.append(RecipeColumn(original, rule.strategy, options, rule.domain))
    now = datetime.now(timezone.utc).isoformat()
    return Recipe(clean_name(name), owner, tuple(columns), plan.groups, skip_malformed, uuid.uuid4().hex, now, now, header_signature(header))


def _occurrences(names: list[str]) -> list[tuple[str, int]]:
    seen: Counter = Counter()
    out = []
    for n in map(normal_header, names):
        seen[n] += 1
        out.append((n, seen[n]))
    return out


def aligned(recipe: Recipe, header: list[str]) -> dict[int, int]:
    """Positions in the header -> positions in the recipe: equal names, the n-th of a name to the n-th."""
    theirs = {k: i for i, k in enumerate(_occurrences([c.name for c in recipe.columns]))}
    return {i: theirs[k] for i, k in enumerate(_occurrences(header)) if k in theirs}


def score(recipe: Recipe, header: list[str]) -> tuple[bool, float]:
    """(exact, share of the columns of both that match)."""
    exact = recipe.header_signature == header_signature(header)
    both = len(aligned(recipe, header))
    return exact, both / max(1, len(header) + len(recipe.columns) - both)


def ranked(recipes: list[Recipe], header: list[str]) -> list[tuple[Recipe, bool, float]]:
    found = [(r, *score(r, header)) for r in recipes]
    found = [x for x in found if x[1] or x[2] > 0]
    by_time = sorted(found, key=lambda x: x[0].updated, reverse=True)
    return sorted(by_time, key=lambda x: (not x[1], -x[2]))


def best(recipes: list[Recipe], header: list[str]) -> Recipe | None:
    return next((r for r, exact, s in ranked(recipes, header) if exact or s >= LEAST_SCORE), None)


def apply(recipe: Recipe, header: list[str], suggested: model.Plan) -> tuple[model.Plan, int]:
    """The plan for a header, suggestions where the recipe has no column, and the number of links dropped."""
    keys = header_keys(header)
    rules, names = dict(suggested.columns), dict(zip(header_keys([c.name for c in recipe.columns]), range(len(recipe.columns)), strict=True))
    match = aligned(recipe, header)
    at = {j: keys[i] for i, j in match.items()}
    for i, j in match.items():
        c = recipe.columns[j]
        kind = model.OPTIONS.get(c.strategy)
        options = kind(**c.options) if kind and (c.options or c.strategy == "Fake") else None
        if isinstance(options, model.DateShiftOptions) and isinstance(suggested.columns[keys[i]].options, model.DateShiftOptions):
            options = replace(options, formats=suggested.columns[keys[i]].options.formats)
        rules[keys[i]] = model.Rule(c.strategy, options, c.mapping_domain)
    groups, dropped = [], 0
    for g in recipe.entity_groups:
        anchor = at.get(names.get(g.anchor, -1))
        members = tuple(at[names[m]] for m in g.members if names.get(m, -1) in at)
        dropped += len(g.members) - len(members) if anchor else len(g.members)
        if anchor and members:
            groups.append(model.EntityGroup(anchor, members))
    return model.Plan(rules, tuple(groups)), dropped


def _camel(name: str) -> str:
    return re.sub("_([a-z])", lambda m: m[1].upper(), name)


def _snake(name: str) -> str:
    return re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name)


def _renamed(x, how):
    if isinstance(x, dict):
        return {how(k): _renamed(v, how) for k, v in x.items() if v is not None}
    return [_renamed(v, how) for v in x] if isinstance(x, (list, tuple)) else x


def to_json(recipe: Recipe) -> str:
    return json.dumps(_renamed(asdict(recipe), _camel), indent=2)


def from_json(text: str) -> Recipe:
    d = _renamed(json.loads(text), _snake)
    if not d.get("id") or d.get("schema_version", 0) > VERSION:
        raise ValueError("no id, or of a later version")
    d["columns"] = tuple(RecipeColumn(**c) for c in d["columns"])
    d["entity_groups"] = tuple(model.EntityGroup(g["anchor"], tuple(g["members"])) for g in d.get("entity_groups", ()))
    return Recipe(**d)


class Store:
    """One JSON file per recipe, replaced atomically; only its owner may change or delete one."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def all(self) -> tuple[list[Recipe], int]:
        """The readable recipes by name, and how many files were not readable."""
        out, bad = [], 0
        for f in sorted(os.listdir(self.folder)):
            if f.endswith(".json"):
                try:
                    with open(os.path.join(self.folder, f), encoding="utf-8") as file:
                        out.append(from_json(file.read()))
                except (ValueError, TypeError, KeyError):
                    bad += 1
        return sorted(out, key=lambda r: r.name.casefold()), bad

    def get(self, id_: str) -> Recipe | None:
        return next((r for r in self.all()[0] if r.id == id_), None)

    def _owned(self, id_: str, owner: str) -> None:
        if (old := self.get(id_)) and old.owner.casefold() != owner.casefold():
            raise PermissionError("the recipe belongs to someone else")

    def save(self, recipe: Recipe, owner: str) -> None:
        if not re.fullmatch(r"[0-9A-Za-z-]+", recipe.id):
            raise ValueError("a recipe needs an id")
        self._owned(recipe.id, owner)
        handle, temp = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.write(to_json(recipe))
        os.replace(temp, os.path.join(self.folder, f"{recipe.id}.json"))

    def delete(self, id_: str, owner: str) -> bool:
        if not self.get(id_):
            return False
        self._owned(id_, owner)
        os.remove(os.path.join(self.folder, f"{id_}.json"))
        return True
