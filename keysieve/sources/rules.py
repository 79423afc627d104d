"""The rule catalogue as data.

Rules are a parameter of every scan.  A catalogue file is a Markdown table with
the columns ``# | id | name | line | kind | triggers | min | charset``; the
default one is ``rules.md`` beside this module.  Any list of
:class:`Rule` works in its place, so custom rules need no code.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PREFIX, CONTAINS, KEY_VALUE, ENDPOINT = "prefix", "contains", "keyvalue", "endpoint"

# The characters each charset admits, as Java/RE2 class bodies.
CHARSETS = {
    "AlphaNum": r"A-Za-z0-9",
    "AlphaNumDash": r"A-Za-z0-9_\-",
    "Base64": r"A-Za-z0-9+/=.",
    "Hex": r"0-9A-Fa-f",
    "Url": r"A-Za-z0-9\-_.~:/?#\[\]@!$&'()*+,;=%",
}

# A rule set is driver-side metadata that becomes one broadcast table and a few
# patterns.  This is the bound that makes broadcasting it safe.
MAX_TRIGGERS = 50_000


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    kind: str
    triggers: tuple[str, ...]
    min_len: int = 0
    charset: str | None = None
    patterns: tuple[str, ...] = ()
    ord: int = 0

    @property
    def specificity(self) -> int:
        """Generic rules give way to any other; a longer id is more specific."""
        return 0 if self.id.startswith("generic-") else len(self.id)


@dataclass(frozen=True)
class RuleSet:
    """Rules in catalogue order.  The order decides conflicts, see ``resolve``."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not self.rules:
            raise ValueError("no rules left to scan with")
        n = sum(len(r.triggers) + len(r.patterns) for r in self.rules)
        if n > MAX_TRIGGERS:
            raise ValueError(f"{n} triggers, at most {MAX_TRIGGERS} are broadcast")

    def subset(self, only=None, exclude=None) -> "RuleSet":
        """Keep the ids in ``only``, then drop those in ``exclude``.

        Both take a list of ids or one comma-separated string.
        """
        only, exclude = _id_list(only), _id_list(exclude)
        if not only and not exclude:
            return self
        return RuleSet(tuple(
            r for r in self.rules
            if (not only or r.id in only) and r.id not in exclude
        ))

    @cached_property
    def triggers(self) -> list[dict]:
        """One row per literal that can make a rule fire.

        ``trig`` is the tagged literal that candidate extraction emits.  A prefix
        trigger is also listed under every longer prefix it starts, because the
        extraction reports the longest one at each position.
        """
        prefixes = {r.triggers[0] for r in self.rules if r.kind == PREFIX}
        rows = []
        for r in self.rules:
            base = dict(
                ord=r.ord, rule_id=r.id, rule_name=r.name, kind=r.kind,
                min_len=r.min_len, specificity=r.specificity,
                charset=CHARSETS[r.charset] if r.charset else None,
            )
            if r.kind == PREFIX:
                lit = r.triggers[0]
                for longer in sorted(p for p in prefixes if p.startswith(lit)):
                    rows.append(dict(base, trig="p:" + longer, literal=lit, trig_ord=0))
            elif r.kind == CONTAINS:
                rows.append(dict(base, trig="c:" + r.triggers[0], literal=r.triggers[0], trig_ord=0))
            elif r.kind == KEY_VALUE:
                for i, key in enumerate(r.triggers):
                    rows.append(dict(base, trig="k:" + key.lower(), literal=key, trig_ord=i))
            else:
                for i, key in enumerate(r.triggers):
                    rows.append(dict(base, trig="e:" + key.lower(), literal=key, trig_ord=i))
                for i, pat in enumerate(r.patterns):
                    rows.append(dict(base, trig="u:" + pat, literal=pat,
                                     trig_ord=len(r.triggers) + i))
        return rows

    def literals(self, tag: str) -> list[str]:
        """Distinct trigger literals of one kind tag, e.g. ``p`` for prefixes."""
        return sorted({t["trig"][2:] for t in self.triggers if t["trig"][0] == tag})

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The catalogue: one row per rule."""
        schema = pa.schema([
            ("ord", pa.int32()), ("rule_id", pa.string()), ("rule_name", pa.string()),
            ("kind", pa.string()), ("triggers", pa.list_(pa.string())),
            ("patterns", pa.list_(pa.string())), ("min_len", pa.int32()),
            ("charset", pa.string()), ("specificity", pa.int32()),
        ])
        return spark.createDataFrame(pa.Table.from_pylist([
            dict(ord=r.ord, rule_id=r.id, rule_name=r.name, kind=r.kind,
                 triggers=list(r.triggers), patterns=list(r.patterns),
                 min_len=r.min_len, charset=r.charset, specificity=r.specificity)
            for r in self.rules
        ], schema=schema))


def _id_list(ids) -> frozenset[str]:
    if ids is None:
        return frozenset()
    if isinstance(ids, str):
        ids = ids.split(",")
    return frozenset(i.strip() for i in ids if i.strip())


def default_catalogue_path() -> Path:
    """The file named by ``KEYSIEVE_RULES``, else the table in the package."""
    named = os.environ.get("KEYSIEVE_RULES")
    return Path(named) if named else Path(__file__).with_name("rules.md")


@lru_cache(maxsize=8)
def load_rules(path: str | None = None) -> RuleSet:
    """Read the catalogue table found in ``path``; a row that is no rule raises."""
    text = Path(path or default_catalogue_path()).read_text(encoding="utf-8")
    rules = []
    for line in text.splitlines():
        if not re.match(r"\s*\|\s*\d", line):
            continue
        # a pipe inside a literal is written \|
        cells = [c.strip().replace("\\|", "|")
                 for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]
        if len(cells) != 8:
            raise ValueError(f"a rule has 8 cells, not {len(cells)}: {line}")
        num, rule_id, name, _, kind, trig, min_len, charset = cells
        if kind.lower() not in (PREFIX, CONTAINS, KEY_VALUE, ENDPOINT):
            raise ValueError(f"unknown kind of rule: {line}")
        if charset and charset not in CHARSETS:
            raise ValueError(f"unknown charset: {line}")
        keys, _, patterns = trig.partition(" patterns ")
        rules.append(Rule(
            id=rule_id, name=name, kind=kind.lower(),
            triggers=tuple(re.findall(r"`([^`]+)`", keys)),
            patterns=tuple(re.findall(r"`([^`]+)`", patterns)),
            min_len=int(min_len or 0), charset=charset or None, ord=int(num),
        ))
    return RuleSet(tuple(sorted(rules, key=lambda r: r.ord)))
