"""Lines x rules -> matches.

Three steps, none of which loops over the catalogue:

1. ``gate_sql`` and ``candidates_sql``: plain searches drop the files and lines on
   which nothing can fire; patterns compiled from the catalogue list, for each line
   left, the trigger literals that could make a rule fire.
2. an equi join of the triggers with the broadcast trigger table.
3. ``match``: the exact test of one trigger on one line, by its kind.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions.text import (
    ALNUM, WS, code_pattern_sql, localhost_sql, looks_like_code_sql, placeholder_sql,
    quote, sql_string,
)
from keysieve.sources.rules import CONTAINS, ENDPOINT, KEY_VALUE, PREFIX, RuleSet

# --- step 1: candidate triggers -------------------------------------------------


def trie_pattern(literals, leaf=lambda literal: "") -> str:
    """One pattern for many literals that shares their common heads.

    At a position it matches the longest literal whose ``leaf`` assertion holds.
    """
    root: dict = {}
    for lit in literals:
        node = root
        for ch in lit:
            node = node.setdefault(ch, {})
        node[""] = lit

    def render(node: dict) -> str:
        options = []
        for ch in sorted(k for k in node if k):
            options.append(quote(ch) + render(node[ch]))
        if "" in node:
            options.append(leaf(node[""]))
        return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"

    heads = "".join(sorted({quote(lit[0]) for lit in literals}))
    return f"(?=[{heads}]){render(root)}"


def prefix_pattern(rules: RuleSet) -> str | None:
    """Finds prefix literals at a left boundary with a long enough token behind."""
    need: dict[str, list[str]] = {}
    for t in rules.triggers:
        if t["kind"] == PREFIX:
            literal = t["trig"][2:]
            rest = max(0, t["min_len"] - len(literal))
            need.setdefault(literal, []).append(f"[{t['charset']}]{{{rest}}}")
    if not need:
        return None

    def leaf(literal: str) -> str:
        return "(?=" + "|".join(sorted(set(need[literal]))) + ")"

    return rf"(?<![{ALNUM}])(?=({trie_pattern(sorted(need), leaf)}))"


def assignment_pattern(rules: RuleSet) -> str | None:
    """Finds the names directly left of ``=`` or ``:`` that have a value."""
    lengths = [r.min_len for r in rules.rules if r.kind == KEY_VALUE]
    if not lengths:
        return None
    # lengths count bytes and a character has at most four
    n = max(1, -(-min(lengths) // 4))
    name = rf"[{ALNUM}_\-]"
    value = rf"""(?:"[^"]{{{n}}}|'[^']{{{n}}}|[^{WS},;"'][^{WS},;]{{{n - 1}}})"""
    return rf"(?<!{name})({name}++)(?={WS}*+[=:]{WS}*+{value})"


def _has(text: str, literal: str) -> str:
    return f"contains({text}, {sql_string(literal)})"


def _dense(text: str, n: int, stops: str = " ") -> str:
    """There are ``n`` characters in a row without a stop."""
    run = f"[^{stops}]{{{n}}}"
    return f"({text} rlike '[{stops}]{run}' or {text} rlike '\\\\A{run}')"


def _spaced(literal: str) -> bool:
    """The literal holds white space, so a token with it is no run without a stop."""
    return bool(re.search(r"\s", literal))


def _odd_keys(rules: RuleSet) -> list[str]:
    """Keys with signs that no name of an assignment has: dots, blanks and others."""
    return [k for k in rules.literals("k") if not all(c.isalnum() or c in "_-" for c in k)]


def _marks(literals) -> list[str]:
    """Short searches that find every one of the literals: similar ones share a head."""
    out: list[str] = []
    for lit in sorted(literals):
        head = os.path.commonprefix([out[-1], lit]) if out else ""
        if len(head) >= 6:
            out[-1] = head
        else:
            out.append(lit)
    return out


@lru_cache(maxsize=64)
def gate_sql(text: str, rules: RuleSet, stops: str = " ") -> str:
    """A cheap test that holds wherever a rule can fire: on a line, or on a whole file.

    Plain searches come first; source code passes at its first ``=``.  Prose has to go
    through all of them, and nearly always ends here.
    """
    separators = [m for m in "=:" if any(
        r.kind in (KEY_VALUE, ENDPOINT) or m in "".join(r.triggers) for r in rules.rules)]
    plain = [x for tag in "cup" for x in rules.literals(tag) if not any(m in x for m in separators)]
    prefixes = set(rules.literals("p"))
    tests = [_has(text, m) for m in separators]
    tests += [_has(text, m) for m in _marks(x for x in plain if x not in prefixes)]
    tests += [_has(text, m) for m in _marks(x for x in prefixes if x in plain and _spaced(x))]
    lengths = [r.min_len for r in rules.rules if r.kind == PREFIX and r.triggers[0] in plain
               and not _spaced(r.triggers[0])]
    if lengths:
        # a token has no space in it
        tests.append(_dense(text, min(lengths), stops))
    return "(" + " or ".join(tests) + ")"


@lru_cache(maxsize=64)
def candidates_sql(line: str, rules: RuleSet) -> str:
    """The tagged trigger literals of a line as an array, in SQL text.

    ``line`` is a column or the variable of a lambda function.
    """
    def found(text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {sql_string(pattern)}, 1)"

    def when(test: str, then: str) -> str:
        return f"if({test}, {then}, cast(array() as array<string>))"

    lists = []
    assigns = f"({_has(line, '=')} or {_has(line, ':')})"

    pattern = assignment_pattern(rules)
    if pattern:
        # a key may start after any dash of the name, and has no more dashes than this
        dashes = max(k.count("-") for k in rules.literals("k"))
        tails = ", ".join(
            f"concat('k:', lower(substring_index(name, '-', -{n})))" for n in range(1, dashes + 2))
        lists.append(when(
            assigns, f"flatten(transform({found(line, pattern)}, name -> array({tails})))"))

    odd = _odd_keys(rules)
    if odd:
        # such a key is looked for as it stands; the exact test decides
        flagged = ", ".join(
            f"if({_has(f'lower({line})', k)}, {sql_string('k:' + k)}, null)" for k in odd)
        lists.append(when(assigns, f"array_compact(array({flagged}))"))

    pattern = prefix_pattern(rules)
    if pattern:
        shortest = [r.min_len for r in rules.rules
                    if r.kind == PREFIX and not _spaced(r.triggers[0])]
        tests = [_dense(line, min(shortest))] if shortest else []
        tests += [_has(line, m) for m in _marks(x for x in rules.literals("p") if _spaced(x))]
        lists.append(when("(" + " or ".join(tests) + ")",
                          f"transform({found(line, pattern)}, p -> concat('p:', p))"))

    needles = rules.literals("c")
    if needles:
        flagged = ", ".join(
            f"if({_has(line, n)}, {sql_string('c:' + n)}, null)" for n in needles)
        lists.append(f"array_compact(array({flagged}))")

    keys = rules.literals("e")
    if keys:
        tried = found(f"lower({line})", f"(?=({trie_pattern(keys)}))")
        lists.append(when(assigns, _with_heads(tried, keys, "e:")))

    urls = rules.literals("u")
    if urls:
        # plain searches are much cheaper than the pattern: let them decide
        marks = [":"] + _marks(u for u in urls if ":" not in u)
        tried = found(line, f"(?=({trie_pattern(urls)}))")
        lists.append(when(
            "(" + " or ".join(_has(line, m) for m in marks) + ")",
            _with_heads(tried, urls, "u:")))

    return f"array_distinct(concat({', '.join(lists)}))"


def _with_heads(found: str, literals, tag: str) -> str:
    """Each found literal and every shorter literal it starts with."""
    heads = {t: [s for s in literals if t.startswith(s)] for t in literals}
    branches = " ".join(
        f"when {sql_string(t)} then array({', '.join(sql_string(tag + s) for s in starts)})"
        for t, starts in heads.items() if len(starts) > 1)
    if not branches:
        return f"transform({found}, t -> concat('{tag}', t))"
    return f"flatten(transform({found}, t -> case t {branches} else array(concat('{tag}', t)) end))"


# --- step 3: exact tests ----------------------------------------------------------

_SEP = rf"{WS}*+[=:]{WS}*+"


def find_pattern(trigger: dict) -> str | None:
    """The pattern whose group 1 is the raw token of a rule, at each place it may be.

    Everything behind the trigger is looked at, not consumed: after a token that does
    not count, the search goes on right behind the trigger.
    """
    literal = quote(trigger["literal"])
    if trigger["kind"] == PREFIX:
        rest = max(0, trigger["min_len"] - len(trigger["literal"]))
        return rf"(?<![{ALNUM}])(?=({literal}[{trigger['charset']}]{{{rest},}}))"
    if trigger["kind"] == KEY_VALUE:
        raw = rf""""[^"]*+"|'[^']*+'|(?!["'])[^{WS},;]*+"""
        return rf"(?<![{ALNUM}_])(?i:{literal})(?![{ALNUM}_])(?={_SEP}({raw}))"
    if trigger["trig"].startswith("e:"):
        # only the first occurrence of the key counts, wherever it is
        raw = rf""""[^"]*+"|'[^']*+'|(?!["'])[^{WS},;}}\]]*+"""
        return rf"(?s)\A(?>.*?(?i:{literal})){_SEP}({raw})"
    return None


def first_pattern(trigger: dict) -> str | None:
    """Finds the first raw token; group 1 is the text before the trigger."""
    if trigger["trig"].startswith("e:"):
        return rf"(?s)\A(?>(.*?)(?i:{quote(trigger['literal'])})){_SEP}"
    find = find_pattern(trigger)
    return None if find is None else rf"(?s)\A(.*?){find}"


def place_pattern(trigger: dict) -> list[str] | None:
    """What stands before a raw token, and behind a bare one, to find a certain token."""
    literal = quote(trigger["literal"])
    if trigger["kind"] == PREFIX:
        return [rf"(?s)\A(.*?)(?<![{ALNUM}])", rf"(?![{trigger['charset']}])"]
    if trigger["kind"] == KEY_VALUE:
        return [rf"(?s)\A(.*?)(?<![{ALNUM}_])(?i:{literal})(?![{ALNUM}_]){_SEP}",
                rf"(?:[{WS},;]|\z)"]
    return None


@lru_cache(maxsize=64)
def trigger_rows(rules: RuleSet) -> list[dict]:
    """The trigger table with the patterns of each trigger."""
    return [dict(t, find=find_pattern(t), first=first_pattern(t), place=place_pattern(t))
            for t in rules.triggers]


# A raw token passes as a secret of its kind.
_IS_SECRET = f"""
    not {placeholder_sql('t.value')} and case kind
      when '{KEY_VALUE}' then octet_length(t.value) >= min_len
        and not {code_pattern_sql('t.value')}
        and (t.quoted or not {looks_like_code_sql('t.value')})
      when '{ENDPOINT}' then t.value <> '' and not {localhost_sql('t.value')}
      else true end
"""

# The first token that does: what was found, without quotes, without the prefix.
_TOKEN = f"""
    get(filter(transform(regexp_extract_all(text, find, 1), (raw, nth) -> struct(
        raw, nth,
        left(raw, 1) in ('"', "'") as quoted,
        if(kind = '{PREFIX}', substring(raw, length(literal) + 1),
           regexp_replace(raw, '(?s)\\\\A(["\\'])(.*)\\\\1\\\\z', '$2')) as value
    )), t -> {_IS_SECRET}), 0)
"""

# Around a literal: back to the last stop before it, on to the next one behind it.
_BEFORE = "if(find is null and contains(text, literal), left(text, instr(text, literal) - 1), null)"
_HEAD = f"""
    regexp_replace(before, if(kind = '{CONTAINS}',
      '(?s)\\\\A.*\\\\p{{IsWhite_Space}}', '(?s)\\\\A.*[\\\\p{{IsWhite_Space}}"\\'=:]'), '')
"""
_AROUND = f"""
    if(kind = '{CONTAINS}',
       concat(head, regexp_extract(substring(text, length(before) + 1),
                                   '\\\\A[^\\\\p{{IsWhite_Space}}]*', 0)),
       regexp_extract(concat(head, substring(text, length(before) + 1)),
                      '\\\\A[^\\\\p{{IsWhite_Space}}"\\',;}}\\\\]]*', 0))
"""

# Where the token is.  The first one is found by a pattern of the trigger, which Spark
# compiles once for all its lines; only a later one takes a pattern of its own.
_OFFSET = """
    octet_length(regexp_extract(text, if(token.nth = 0, first, concat(place[0], '\\\\Q',
      replace(token.raw, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E', if(token.quoted, '', place[1]))), 1))
"""

_HIT = f"""
    case
      when kind = '{CONTAINS}' and before is not null then named_struct(
        'matched', literal, 'secret_raw', around_it, 'col0', octet_length(before))
      when find is null and not {localhost_sql('around_it')}
           and octet_length(around_it) > octet_length(literal) then named_struct(
        'matched', around_it,
        'secret_raw', regexp_replace(around_it, '(?s)\\\\A[^=]*=', ''),
        'col0', octet_length(before) - octet_length(head))
      when token is not null then named_struct(
        'matched', if(kind = '{PREFIX}', token.raw, concat(literal, '=', token.value)),
        'secret_raw', if(kind = '{PREFIX}', token.raw, token.value),
        'col0', {_OFFSET})
    end
"""


def match(joined: DataFrame, kept: list[str]) -> DataFrame:
    """The exact test of the joined trigger on ``text``; drops what fails it.

    It proceeds column by column, because each is used more than once by the next.
    The hit is exploded from an array of none or one: a filter on the test itself
    would be pushed below it, and the test be made twice.
    """
    rule = ["ord", "trig_ord", "rule_id", "rule_name", "kind", "specificity"]
    return (
        joined.selectExpr("*", f"{_TOKEN} as token", f"{_BEFORE} as before")
        .selectExpr("*", f"{_HEAD} as head")
        .selectExpr("*", f"{_AROUND} as around_it")
        .selectExpr(*[f"`{c}`" for c in kept], *rule,
                    f"explode_outer(array_compact(array({_HIT}))) as hit")
        .where("hit is not null")
        .selectExpr(*[f"`{c}`" for c in kept], *rule, "hit.*")
    )


# --- the operator -------------------------------------------------------------------

_TRIGGER_SCHEMA = pa.schema([
    ("trig", pa.string()), ("ord", pa.int32()), ("trig_ord", pa.int32()),
    ("rule_id", pa.string()), ("rule_name", pa.string()), ("kind", pa.string()),
    ("literal", pa.string()), ("min_len", pa.int32()), ("specificity", pa.int32()),
    ("find", pa.string()), ("first", pa.string()), ("place", pa.list_(pa.string())),
])


def triggers_df(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The broadcast side of the detection join: one row per trigger."""
    rows = [{f: t[f] for f in _TRIGGER_SCHEMA.names} for t in trigger_rows(rules)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_TRIGGER_SCHEMA))


def with_candidates(lines: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds ``cand``, the array of candidate triggers, to a table with ``text``."""
    return lines.withColumn("cand", F.expr(candidates_sql("text", rules)))


def detect(lines: DataFrame, rules: RuleSet) -> DataFrame:
    """All rule matches of all lines, at most one per line and trigger.

    ``lines`` has the columns ``text`` and ``cand``; the others are carried along.
    Adds the rule's columns and ``matched``, ``secret_raw`` and ``col0``, the byte
    offset of the match.
    """
    kept = [c for c in lines.columns if c not in ("text", "cand")]
    # explode_outer: a plain explode makes the optimizer test size(cand) first, by
    # computing it a second time; the join drops the null rows
    found = lines.withColumn("trig", F.explode_outer("cand")).drop("cand")
    # bounded by MAX_TRIGGERS, so the broadcast never grows with the data
    joined = found.join(F.broadcast(triggers_df(lines.sparkSession, rules)), "trig")
    # next to each other, lines with the same trigger share its compiled pattern
    return match(joined.sortWithinPartitions("trig"), kept)
