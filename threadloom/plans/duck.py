"""Helpers that write the SQL the registered queries are checked against."""

from __future__ import annotations

from threadloom import fixed_values as fv
from threadloom.functions.text import WORD_SET, WS, WS_SET, phrase_order


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(repl)}, 'g')"


def strip(c: str) -> str:
    return rx(c, f"\\A{WS}+|{WS}+\\z")


def squeeze(c: str) -> str:
    return f"trim({rx(c, WS + '+', ' ')})"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {lit(pattern)}))"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {lit(WS + '+')}), lambda w: w <> '')"


def clean_text(c: str) -> str:
    out = f"translate(coalesce({c}, ''), {lit(chr(0xad) + chr(0x200b) + chr(0x200c) + chr(0x200d))}, '')"
    out = f"regexp_replace({out}, '\\r\\n|\\r', chr(10), 'g')"
    out = rx(out, " +", " ")
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    out = (f"array_to_string(list_transform(string_split({out}, chr(10)), "
           f"lambda l: {strip('l')}), chr(10))")
    return strip(out)


def drop_phrases(lowered: str) -> str:
    out = lowered
    for group in (fv.GREETINGS, fv.FILLERS):
        for p in phrase_order(group):
            out = (f"replace({out}, CASE WHEN contains({lowered}, {lit(p)}) THEN {lit(p)} "
                   f"ELSE '' END, '')")
    return out


def clean_chat(c: str) -> str:
    out = rx(c, "<@[A-Z0-9]+>")
    out = rx(out, r"<#([A-Z0-9]+)\|([^>]+)>", r"#\2")
    out = rx(out, r"<([^|>]+)\|([^>]+)>", r"\2")
    out = rx(out, "<([^>]+)>", r"\1")
    out = rx(out, f":[{WORD_SET}+-]+:")
    return squeeze(out)


def filter_message_ctes(source: str, key: str, text: str, name: str = "filtered") -> str:
    """CTEs that give ``name(key, msg)`` with the filtered message per row of ``source``."""
    raw = clean_text(rx(clean_chat(text), f":[{WORD_SET}+-]+:"))
    return f"""{name}_s AS (
  SELECT {key}, regexp_split_to_array({raw}, {lit('[.!?]' + WS + '+')}) AS parts FROM {source}),
{name}_l AS (
  SELECT {key}, i, lower({strip('parts[i]')}) AS l
  FROM (SELECT {key}, parts, unnest(range(1, len(parts) + 1)) AS i FROM {name}_s)),
{name}_d AS (SELECT {key}, i, {drop_phrases('l')} AS d FROM {name}_l),
{name} AS (
  SELECT {key}, {strip('''coalesce(string_agg(CASE WHEN len(''' + words('d') + ''') > 3 THEN '''
                       + strip('d') + ''' END, '. ' ORDER BY i), '')''')} AS msg
  FROM {name}_d GROUP BY {key})"""


NOT_WS = f"[^{WS_SET}]"


def strip_html(c: str) -> str:
    out = rx(f"coalesce({c}, '')", "<[^>]+>")
    for entity, char in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&nbsp;", " ")]:
        out = f"replace({out}, {lit(entity)}, {lit(char)})"
    return strip(out)


def html_text(c: str) -> str:
    out = rx(f"coalesce({c}, '')", r"(?is)<script\b.*?</script>")
    out = rx(out, r"(?is)<style\b.*?</style>")
    out = rx(out, r"(?s)<!--.*?-->")
    out = strip_html(out)
    return strip(f"regexp_replace({out}, {lit('\\n' + WS + '*\\n+')}, chr(10) || chr(10), 'g')")


def contains_any(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(n)})" for n in needles) + ")"


def values(rows: list[tuple], name: str, *cols: str) -> str:
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return lit(v)
        if isinstance(v, list):
            return "[" + ", ".join(one(x) for x in v) + "]::VARCHAR[]"
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {name}({', '.join(cols)})"
