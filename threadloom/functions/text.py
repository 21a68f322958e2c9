"""Text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import fixed_values as fv

# Unicode white space and word characters, spelled out so that the meaning does not
# depend on regex flags.
WS_SET = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_SET}]"
WORD_SET = r"\p{L}\p{N}_"
# The same white space as single characters.
WS_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Give ``value`` a name inside ``body``, so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def clean_text(c: Column, remove_extra_spaces: bool = True) -> Column:
    """Drop invisible characters, unify line ends, squeeze spaces and blank lines."""
    out = F.translate(empty_if_null(c), "­​‌‍", "")
    out = F.regexp_replace(out, "\r\n|\r", "\n")
    if remove_extra_spaces:
        out = F.regexp_replace(out, " +", " ")
        out = F.regexp_replace(out, "\n{3,}", "\n\n")
        out = F.array_join(F.transform(F.split(out, "\n"), strip), "\n")
    return strip(out)


def phrase_order(phrases: list[str]) -> list[str]:
    """Longest first, then alphabetical: a fixed order for removing phrases."""
    return sorted(set(phrases), key=lambda p: (-len(p), p))


def filter_sentence(
    c: Column,
    greetings: list[str] | None = None,
    fillers: list[str] | None = None,
    min_words: int = 3,
    word_boundary: bool = False,
) -> Column:
    """Lower-case, remove small-talk phrases, and drop what has too few words left.

    A phrase counts when the untouched sentence contains it, even inside a word;
    ``word_boundary`` restricts removal to whole words.
    """
    groups = [phrase_order(fv.GREETINGS if greetings is None else greetings),
              phrase_order(fv.FILLERS if fillers is None else fillers)]

    def reduce_phrases(lowered: Column) -> Column:
        out = lowered
        for phrase in [p for group in groups for p in group]:
            if word_boundary:
                quoted = "".join(ch if ch.isalnum() or not ch.isascii() else "\\" + ch
                                 for ch in phrase)
                out = F.regexp_replace(
                    out, f"(?<![{WORD_SET}]){quoted}(?![{WORD_SET}])", "")
            else:
                # An empty search text leaves the string as it is.
                search = F.when(F.contains(lowered, F.lit(phrase)), phrase).otherwise("")
                out = F.replace(out, search, F.lit(""))
        return out

    reduced = let(F.lower(strip(empty_if_null(c))), reduce_phrases)
    return let(reduced, lambda r: F.when(word_count(r) > min_words, strip(r)).otherwise(""))


def clean_chat(c: Column) -> Column:
    """Mentions, channel links, labelled links and emoji codes of chat markup."""
    out = F.regexp_replace(c, "<@[A-Z0-9]+>", "")
    out = F.regexp_replace(out, r"<#([A-Z0-9]+)\|([^>]+)>", "#$2")
    out = F.regexp_replace(out, r"<([^|>]+)\|([^>]+)>", "$2")
    out = F.regexp_replace(out, "<([^>]+)>", "$1")
    out = F.regexp_replace(out, f":[{WORD_SET}+-]+:", "")
    return squeeze(out)


def filter_message(c: Column, word_boundary: bool = False) -> Column:
    """Clean a chat message and keep the sentences that say something."""
    text = F.regexp_replace(clean_chat(empty_if_null(c)), f":[{WORD_SET}+-]+:", "")
    sentences = F.split(clean_text(text), f"[.!?]{WS}+")
    kept = F.transform(sentences, lambda s: filter_sentence(s, word_boundary=word_boundary))
    return strip(F.array_join(F.filter(kept, lambda s: s != ""), ". "))


def strip_html(c: Column) -> Column:
    """Remove tags, then decode six entities in order."""
    out = F.regexp_replace(empty_if_null(c), "<[^>]+>", "")
    for entity, char in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&nbsp;", " ")]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def html_text(c: Column) -> Column:
    """Readable text of a page: scripts, styles, comments and tags removed."""
    out = F.regexp_replace(empty_if_null(c), r"(?is)<script\b.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = strip_html(out)
    return strip(F.regexp_replace(out, f"\n{WS}*\n+", "\n\n"))


def first_url(c: Column) -> Column:
    """First http(s) address, else first www address, without closing punctuation."""
    not_ws = f"[^{WS_SET}]"
    found = F.coalesce(
        null_if_empty(F.regexp_extract(c, f"https?://{not_ws}+", 0)),
        null_if_empty(F.regexp_extract(c, f"www\\.{not_ws}+", 0)),
    )
    return F.regexp_replace(found, r"[.,;:!?)]+\z", "")


def truncate(c: Column, max_length: int = 500, suffix: str = "...") -> Column:
    return F.when(
        F.length(c) > max_length,
        F.concat(F.substring(c, 1, max_length - len(suffix)), F.lit(suffix)),
    ).otherwise(c)


def safe_path(c: Column, max_length: int = 200) -> Column:
    """A string usable as one path component."""
    out = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")
    out = F.regexp_replace(out, r"\A[ .]+|[ .]+\z", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "unknown").otherwise(
        F.substring(out, 1, max_length))


def file_stem(c: Column) -> Column:
    """Last path part without its last suffix."""
    name = F.regexp_extract(c, r"([^/]*)/*\z", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def video_id(c: Column) -> Column:
    """File stem up to its first dot."""
    return null_if_empty(F.split_part(file_stem(c), F.lit("."), F.lit(1)))


def strip_quotes(c: Column) -> Column:
    return F.replace(c, F.lit(">>"), F.lit(""))


def cache_key(query: Column, fetch_k: Column, types: Column) -> Column:
    """Hash of a query and its context; case is kept, some characters are not."""
    context = F.concat(
        F.lit("k="), fetch_k.cast("string"),
        F.when(F.size(types) > 0,
               F.concat(F.lit(":types="), F.array_join(F.array_sort(types), ",")))
        .otherwise(""),
    )
    content = F.concat(query, F.lit(":"), context)
    return F.md5(strip(F.translate(content, "\n\r\t?!` .,", "")))


def join_hyphenated(c: Column) -> Column:
    """Join lines that end in a hyphen with the next line, as a fold over lines."""
    start = F.struct(F.array().cast("array<string>").alias("done"),
                     F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        open_ends = F.endswith(F.regexp_replace(acc["open"], f"{WS}+\\z", ""), F.lit("-"))
        joined = F.concat(
            F.regexp_replace(acc["open"], f"-{WS}*\\z", ""),
            F.regexp_replace(line, f"\\A{WS}+", ""))
        return (
            F.when(acc["open"].isNull(),
                   F.struct(acc["done"].alias("done"), line.alias("open")))
            .when(open_ends, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"),
                                line.alias("open")))
        )

    return F.aggregate(F.split(c, "\n"), start, step,
                       lambda acc: F.array_append(acc["done"], acc["open"]))


def normalize_paper(c: Column) -> Column:
    """Hyphenated lines joined; known section names marked as headings."""
    names = F.array(*[F.lit(n) for n in fv.SECTION_NAMES])

    def mark(line: Column) -> Column:
        bare = strip(F.regexp_replace(strip(line), r"\A[0-9]+\.?" + WS + "*", ""))
        return F.when(F.array_contains(names, F.lower(bare)),
                      F.concat(F.lit("### "), bare)).otherwise(line)

    return F.when(strip(c) == "", c).otherwise(
        F.array_join(F.transform(join_hyphenated(c), mark), "\n"))
