"""Schemas of the graph tables, and parameters whose defaults operators share."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

ENTITIES = "name string, seq string, type string, types array<string>, aliases array<string>, text array<string>, img array<struct<path:string,caption:string,source:string,page:int>>, degree long, hub boolean"
TRIPLES = "seq string, h string, r string, u string, sources array<string>"
CANDIDATES = "seq long, h string, r string, u string, source string, context string"
MANIFEST = "path string, hash string, n_triples long, processed_at timestamp"
ITEMS = "qid string, type string, answer_atoms array<string>, gold_triples array<struct<h:string,r:string,u:string>>, hops int, spec string, images array<string>"
RESULTS = "qid string, type string, multimodal boolean, correct boolean, precision double, recall double, recall_entailed double, n_calls int, seconds double, answer string, error string"

#: Groups of relations that one wording fits.
CONFUSABLE = [
    ["made_from", "uses_material", "sourced_from", "extracted_from", "coated_with"],
    ["located_in", "produced_in", "originated_in", "imported_from", "part_of", "born_in", "enshrined_in"],
    ["made_by", "developed_by", "founded_by", "produced_by", "authored_by", "processed_by"],
    ["is_a", "recognized_as", "designated_as", "revered_as"],
    ["used_for", "has_function", "used_by", "leaf_used_as", "cultivated_for"],
    ["produces", "supplied_to"],
]

#: Weight of a relation as the axis of a contrast; 1.0 where it is not listed.
CONTRAST_WEIGHT = {
    "made_from": 3.0, "uses_method": 3.0, "uses_material": 3.0, "has_property": 3.0, "processed_by": 3.0, "coated_with": 3.0,
    "has_function": 2.5, "used_for": 2.5, "requires_tool": 2.5, "made_by": 1.5, "produces": 1.5,
    "located_in": 0.25, "produced_in": 0.25, "originated_in": 0.25,
}


@dataclass(frozen=True)
class Config:
    """All thresholds of the engine; every operator takes them as arguments with these defaults."""

    text_cap: int = 5
    text_chars: int = 400
    image_cap: int = 6
    dedup: float = 0.92
    detector_top: int = 8
    detector_least: float = 0.60
    hub_degree: int = 40
    sink_degree: int = 15
    type_in: int = 2
    type_share: float = 0.90
    type_out: int = 2
    per_relation: int = 8
    per_page: int = 40
    beam: int = 3
    depth: int = 3
    pages: int = 24
    evidence: int = 5
    verify: int = 8
    alpha: float = 0.7
    gamma: float = 0.7
    step_weight: float = 0.6
    most_atoms: int = 8
    relation_class: dict = field(default_factory=lambda: {"associated_with": "weak", "is_a": "taxonomic"})

    @classmethod
    def of(cls, values: Settings) -> Config:
        """The thresholds that settings name, wherever they stand in them; others keep their defaults."""
        found = {}
        for f in fields(cls):
            value = values.find(f.name)
            if value is not None:
                found[f.name] = value
        return cls(**found)


class Settings:
    """Nested settings of a file, and the paths of a project beside it."""

    def __init__(self, raw: dict, base: str = "."):
        self.raw, self.base = raw, base

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings from a file of indented `key: value` lines (with lists of `- value`), or from JSON."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        raw = json.loads(text) if text.lstrip().startswith("{") else _indented(text)
        return cls(raw, os.path.dirname(os.path.abspath(path)))

    def get(self, *keys: str, default=None):
        node = self.raw
        for k in keys:
            if not isinstance(node, dict) or k not in node:
                return default
            node = node[k]
        return node

    def find(self, name: str, node=None):
        """The first value under a key of this name, at any depth."""
        node = self.raw if node is None else node
        if name in node:
            return node[name]
        for value in node.values():
            if isinstance(value, dict) and (found := self.find(name, value)) is not None:
                return found
        return None

    def path(self, name: str, default: str) -> str:
        """A path of the section `paths`; graph and manifest files are in its output folder."""
        own = self.get("paths", name, default=default)
        folder = self.get("paths", "output_dir", default="output") if name.endswith("_file") else ""
        return os.path.normpath(os.path.join(self.base, folder, own))


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    plain = text.partition(" #")[0].strip()
    if plain in ("", "null", "~"):
        return None
    if plain in ("true", "false"):
        return plain == "true"
    if plain.startswith("[") and plain.endswith("]"):
        return [_scalar(x) for x in plain[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(plain)
        except ValueError:
            pass
    return plain


def _indented(text: str) -> dict:
    """Mappings by indentation; a key without a value opens one, or a list where `- ` lines follow."""
    root: dict = {}
    open_: list[tuple[int, object, object, str]] = [(-1, root, None, "")]
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        while len(open_) > 1 and depth <= open_[-1][0] and not (bare.startswith("- ") and depth == open_[-1][0]):
            open_.pop()
        _, node, parent, key = open_[-1]
        if bare.startswith("- "):
            if not isinstance(node, list):
                node = parent[key] = []
                open_[-1] = (open_[-1][0], node, parent, key)
            node.append(_scalar(bare[2:]))
            continue
        name, _, value = bare.partition(":")
        name = str(_scalar(name))
        if value.strip() and not value.strip().startswith("#"):
            node[name] = _scalar(value)
        else:
            node[name] = {}
            open_.append((depth, node[name], node, name))
    return root
