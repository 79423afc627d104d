"""The scan in DuckDB's SQL, written for the check and on nothing but the rule table.

It tries every trigger on every line: plain and slow, and a different way to the same
result than the plan it checks.
"""

from __future__ import annotations

from keysieve.functions import text as T
from keysieve.sources.files import BINARY_EXTENSIONS, LOCK_FILES, SKIPPED_DIRS
from keysieve.sources.rules import CHARSETS, RuleSet, load_rules


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _re(literal: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in literal)


def _any(literals) -> str:
    return "(?:" + "|".join(_re(s) for s in literals) + ")"


def _ends(raw: str) -> str:
    return rf"""("[^"]*"|'[^']*'|{raw})"""


def rules_cte(rules: RuleSet) -> str:
    rows = []
    for r in rules.rules:
        def row(i, form, literal, pattern):
            rows.append(f"({r.ord},{i},{q(r.id)},{q(r.name)},{r.specificity},'{form}',"
                        f"{q(literal)},{r.min_len},{q(pattern)})")

        if r.kind == "prefix":
            lit, cs = r.triggers[0], CHARSETS[r.charset]
            rest = max(0, r.min_len - len(lit))
            row(0, "p", lit, rf"(^|.)({_re(lit)}[{cs}]{{{rest},}})")
        elif r.kind == "contains":
            row(0, "c", r.triggers[0], None)
        else:
            form = "k" if r.kind == "keyvalue" else "e"
            for i, key in enumerate(r.triggers):
                if form == "k":
                    bare = r"""[^\s,;"'][^\s,;]*"""
                    pat = rf"(^|.)(?i:{_re(key)})\s*[=:]\s*" + _ends(bare)
                else:
                    pat = None
                row(i, form, key, pat)
            for i, pat in enumerate(r.patterns):
                row(len(r.triggers) + i, "u", pat, None)
    return ("rules(ord, trig_ord, rule_id, rule_name, spec, form, literal, min_len, pat) AS "
            "(VALUES " + ",\n".join(rows) + ")")


def placeholder(v: str) -> str:
    v = f"lower({v})"
    words = ", ".join(q(w) for w in T.PLACEHOLDER_WORDS)
    starts = " OR ".join(f"starts_with({v}, {q(s)})" for s in T.PLACEHOLDER_STARTS)
    parts = " OR ".join(f"contains({v}, {q(s)})" for s in T.PLACEHOLDER_PARTS)
    ends = " OR ".join(f"suffix({v}, {q(s)})" for s in T.PLACEHOLDER_ENDS)
    masked = q("^(?:" + _any(T.MASKED_TOKEN_HEADS) + "x{8,}|x{3,})$")
    return f"({v} IN ({words}) OR {starts} OR {parts} OR {ends} OR regexp_matches({v}, {masked}))"


def code_pattern(v: str) -> str:
    parts = " OR ".join(f"contains({v}, {q(s)})" for s in T.CODE_PARTS)
    starts = " OR ".join(f"starts_with({v}, {q(s)})" for s in T.CODE_STARTS)
    return f"({parts} OR {starts} OR (contains({v}, '(') AND contains({v}, ')')))"


def looks_like_code(v: str) -> str:
    heads = " OR ".join(f"starts_with({v}, {q(s)})" for s in ["http", *T.DOTTED_TOKEN_HEADS])
    return (f"((contains({v}, '.') AND NOT ({heads})) OR contains({v}, '[') OR contains({v}, '(')"
            f" OR left({v}, 1) IN ('$', '@', '#', '*')"
            f" OR (contains({v}, '_') AND regexp_matches({v}, '^[\\p{{Ll}}_]+$')))")


def localhost(v: str) -> str:
    return "(" + " OR ".join(f"contains(lower({v}), {q(s)})" for s in T.LOOPBACK_PARTS) + ")"


def redact(s: str) -> str:
    n = f"least(4, length({s}) // 4)"
    return (f"CASE WHEN length({s}) <= 10 THEN repeat('*', length({s})) "
            f"ELSE left({s}, {n}) || '...' || right({s}, {n}) END")


def scannable(path: str) -> str:
    dirs = ", ".join(q(d) for d in SKIPPED_DIRS)
    exts = ", ".join(q(e) for e in BINARY_EXTENSIONS)
    locks = ", ".join(q(e) for e in LOCK_FILES)
    parts = f"string_split({path}, '/')"
    name = f"{parts}[-1]"
    return f"""(NOT list_has_any({parts}, [{dirs}])
        AND len(list_filter({parts}[:-2], lambda d: starts_with(d, '.') AND d NOT IN ('.', '..'))) = 0
        AND lower(regexp_extract({name}, '.\\.([^.]*)$', 1)) NOT IN ({exts})
        AND {name} NOT IN ({locks}))"""


def lines_ctes(files: str, key: str = "repo, path", filtered: bool = True) -> str:
    """all_lines(key, line, text) of a table with ``content``."""
    where = f"WHERE {scannable('path')}" if filtered else ""
    return f"""
    all_lines AS (
      SELECT {key}, line, CASE WHEN line < n AND suffix(t, chr(13)) THEN left(t, -1) ELSE t END AS text
      FROM (SELECT {key}, unnest(parts) AS t, generate_subscripts(parts, 1) AS line, len(parts) AS n
            FROM (SELECT {key}, string_split(content, chr(10)) AS parts FROM {files} {where}) a) b
      WHERE NOT (line = n AND t = ''))"""


def findings_ctes(files: str, key: str = "repo, path", rules: RuleSet | None = None,
                  filtered: bool = True) -> str:
    """CTEs that end in found(key, line, col0, pos, rule_id, rule_name, matched, secret_raw)."""
    rules = rules or load_rules()
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in (key + ", line").split(","))
    url_stop, end_stop = r"""[^\s"'=:]*$""", r"""^[^\s"',;}\]]*"""
    served = r"^\s*[=:]\s*" + _ends(r"""[^\s,;"'}\]][^\s,;}\]]*""")
    return f"""{rules_cte(rules)},
    {lines_ctes(files, key, filtered)},
    pairs AS (
      SELECT {key}, line, text, r.*, instr(text, literal) AS loc
      FROM all_lines l JOIN (SELECT * FROM rules WHERE form NOT IN ('k', 'e')) r
        ON contains(l.text, r.literal)
      UNION ALL
      SELECT {key}, line, text, r.* EXCLUDE (low), instr(lower(text), low) AS loc
      FROM (SELECT *, lower(text) AS lowered FROM all_lines
            WHERE contains(text, '=') OR contains(text, ':')) l
      JOIN (SELECT *, lower(literal) AS low FROM rules WHERE form IN ('k', 'e')) r
        ON contains(l.lowered, r.low)),
    tried AS (
      SELECT * EXCLUDE (found_list), unnest(found_list).raw AS raw, unnest(found_list).prev AS prev,
             generate_subscripts(found_list, 1) AS nth
      FROM (SELECT *, CASE WHEN form IN ('p', 'k') THEN list_transform(
                list_zip(regexp_extract_all(text, pat, 1), regexp_extract_all(text, pat, 2)),
                lambda z: struct_pack(prev := z[1], raw := z[2]))
              WHEN form = 'e' THEN [struct_pack(prev := '', raw := regexp_extract(
                substr(text, loc + length(literal)), {q(served)}, 1))]
              ELSE [struct_pack(prev := '', raw := '')] END AS found_list
            FROM pairs)),
    valued AS (
      SELECT *, CASE WHEN form = 'p' THEN substr(raw, length(literal) + 1)
                     WHEN left(raw, 1) IN ('"', '''') THEN substr(raw, 2, length(raw) - 2)
                     ELSE raw END AS val,
             left(raw, 1) IN ('"', '''') AS quoted,
             substr(text, 1, loc - 1) AS before,
             regexp_extract(substr(text, 1, loc - 1), {q(url_stop)}) AS tail,
             regexp_extract(substr(text, 1, loc - 1), '[^\\s]*$') AS word
      FROM tried),
    cut AS (
      SELECT *, CASE form WHEN 'c' THEN word || regexp_extract(substr(text, loc), '^[^\\s]*')
                          WHEN 'u' THEN regexp_extract(tail || substr(text, loc), {q(end_stop)})
                END AS piece
      FROM valued),
    passed AS (
      SELECT *, row_number() OVER (PARTITION BY {key}, line, ord ORDER BY trig_ord, nth) AS choice
      FROM cut WHERE CASE form
        WHEN 'p' THEN NOT regexp_matches(prev, '[\\p{{L}}\\p{{N}}]') AND NOT {placeholder('val')}
        WHEN 'k' THEN NOT regexp_matches(prev, '[\\p{{L}}\\p{{N}}_]') AND strlen(val) >= min_len AND NOT {placeholder('val')}
             AND NOT {code_pattern('val')} AND (quoted OR NOT {looks_like_code('val')})
        WHEN 'e' THEN val <> '' AND NOT {localhost('val')} AND NOT {placeholder('val')}
        WHEN 'u' THEN NOT {localhost('piece')} AND strlen(piece) > strlen(literal)
        ELSE TRUE END),
    hits AS (
      SELECT {key}, line, ord, rule_id, rule_name, spec,
        CASE form WHEN 'p' THEN raw WHEN 'c' THEN literal WHEN 'u' THEN piece
             ELSE literal || '=' || val END AS matched,
        CASE form WHEN 'p' THEN raw WHEN 'c' THEN piece
             WHEN 'u' THEN CASE WHEN contains(piece, '=') THEN substr(piece, instr(piece, '=') + 1)
                           ELSE piece END
             ELSE val END AS secret_raw,
        CASE form
          WHEN 'p' THEN strlen(substr(text, 1, instr(text, raw) - 1))
          WHEN 'k' THEN strlen(regexp_extract(text, '^(.*?)(?i:' || regexp_escape(literal) || ')\\s*[=:]\\s*'
               || regexp_escape(raw), 1))
          WHEN 'u' THEN strlen(before) - strlen(tail)
          ELSE strlen(before) END AS col0
      FROM passed WHERE choice = 1),
    ordered AS (
      SELECT *, row_number() OVER (PARTITION BY {key}, line ORDER BY ord) AS n FROM hits),
    fold AS (
      SELECT {key}, line, n, [struct_pack(o := ord, s := spec, c := col0)] AS acc
      FROM ordered WHERE n = 1
      UNION ALL
      SELECT {", ".join("a." + c.strip() for c in key.split(","))}, a.line, b.n,
        CASE WHEN len(list_filter(a.acc,
               lambda e: abs(b.col0 - (e.c + 1)) < 15 AND e.s >= b.spec)) > 0 THEN a.acc
             ELSE list_concat(list_filter(a.acc,
               lambda e: NOT (abs(b.col0 - (e.c + 1)) < 15) OR e.s > b.spec),
               [struct_pack(o := b.ord, s := b.spec, c := b.col0)]) END
      FROM fold a JOIN ordered b ON {on} AND b.n = a.n + 1),
    kept AS (
      SELECT {key}, line, unnest(acc).o AS ord, generate_subscripts(acc, 1) - 1 AS pos
      FROM fold QUALIFY n = max(n) OVER (PARTITION BY {key}, line)),
    found AS (
      SELECT {", ".join("a." + c.strip() for c in key.split(","))}, a.line, b.col0, a.pos,
             b.rule_id, b.rule_name, b.matched, b.secret_raw
      FROM kept a JOIN hits b ON {on} AND a.ord = b.ord)"""
