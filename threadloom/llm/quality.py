"""Quality rules as a short-circuit cascade, in column expressions only.

A rule is a reject condition with a cost. On a bounded sample the cascade measures how often each
rule rejects (given that the rules before it did not) and what it costs, puts the rules in order of
rejections per cost, and evaluates them as one CASE expression, which stops at the first hit. The
order changes the work and the column ``rejected_by``, never which documents are kept.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged
alike; an empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import BLANK, fresh

# The first rows are judged by all rules to order them. Only the order depends on them.
SAMPLE_ROWS = 1_000

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Words of a text; none for a null or blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def symbol_count(text: Column) -> Column:
    """Splitting at each symbol makes one part more than there are symbols."""
    return (F.size(F.split(F.coalesce(text, F.lit("")), f"[{SYMBOLS}]")) - 1).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(word_hashes: Column) -> Column:
    """A 64-bit hash of the three words from each position on."""
    starts = F.slice(word_hashes, F.lit(1), F.greatest(F.size(word_hashes) - 2, F.lit(0)))
    return F.transform(starts, lambda h, k: F.xxhash64(h, F.get(word_hashes, k + 1), F.get(word_hashes, k + 2)))


def position_bits(windows: Column) -> Column:
    """Mask of the low bits that hold any position in ``windows``."""
    bits = F.length(F.bin(F.size(windows).cast("long")))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def sorted_keys(windows: Column, mask: Column) -> Column:
    """The hashes in order, the low bits of each replaced by its position: plain longs sort fast."""
    return F.sort_array(F.transform(windows, lambda h, k: F.coalesce(
        h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(k.cast("long")), F.lit(0).cast("long"))))


def twins(keys: Column, mask: Column) -> Column:
    """The keys that agree in the high bits with a neighbour."""
    high = F.bitwise_not(mask)

    def close(x: Column, k: Column) -> Column:  # no element there: null, which is not true
        return x.bitwiseXOR(F.get(keys, k)).bitwiseAND(high) == 0

    return F.filter(keys, lambda x, k: close(x, k - 1) | close(x, k + 1))


def repeated_starts(windows: Column, mask: Column, near: Column) -> Column:
    """Starts, in order, of the windows that occur at least twice.

    ``near`` has all of them, as equal windows are neighbours in order. Where two different
    windows agree in the high bits (about one long text in 100,000), it may have others too; such
    a text is sorted by the whole hash instead.
    """
    def position(x: Column) -> Column:
        return x.bitwiseAND(mask).cast("int")

    def clash(x: Column, k: Column) -> Column:
        return ((x.bitwiseXOR(F.get(near, k)).bitwiseAND(F.bitwise_not(mask)) == 0)
                & (F.get(windows, position(x)) != F.get(windows, position(F.get(near, k)))))

    mixed = F.size(F.filter(near, lambda x, k: clash(x, k - 1))) > 0
    whole = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    exact = F.transform(F.array(whole), lambda rows: F.filter(rows, lambda x, k: (
        F.get(rows, k - 1)["h"] == x["h"]) | (F.get(rows, k + 1)["h"] == x["h"])))[0]
    return F.sort_array(F.when(mixed, F.transform(exact, lambda x: x["k"])).otherwise(
        F.transform(near, position)))


def covered(starts: Column) -> Column:
    """Words inside at least one of the three-word windows that begin at ``starts``."""
    steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for a document to drop. ``cost`` is in nanoseconds, by the constants below."""

    name: str
    reject: Column
    cost: Column


# Measured nanoseconds: one pass over a character by a pattern, handling a word, a comparison.
CHAR_NS, WORD_NS, COMPARE_NS = 6.0, 150.0, 20.0


def standard_rules(text: Column, measures: dict[str, Column]) -> list[Rule]:
    """Junk of the usual kinds. ``measures`` names columns with the base measures."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text).cast("double")
    n_words, in_words = measures["n_words"], measures["word_chars"]
    lines = F.size(F.split(text, "\n"))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    exclaims = F.length(F.regexp_replace(text, r"[^!?]+", ""))
    compare = F.lit(COMPARE_NS)
    return [
        Rule("symbols", measures["n_symbols"] * 10 > n_words, compare),
        Rule("word_length", (in_words < 2 * n_words) | (in_words > 20 * n_words), compare),
        Rule("exclaims", exclaims * 4 > n_words, chars * CHAR_NS),
        Rule("capitals", capitals * 2 > in_words, chars * CHAR_NS),
        Rule("duplicate_lines", measures["n_dup_lines"] * 2 > lines, chars * CHAR_NS + compare),
    ]


def cascade_order(measured_rows: DataFrame, rules: list[Rule], sample: int = SAMPLE_ROWS) -> list[str]:
    """Greedy order: next comes the rule with most rejections per cost among the rows still standing.

    Of the first ``sample`` rows only the verdicts and costs come to the driver.
    """
    flags = [F.coalesce(r.reject, F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    costs = [F.coalesce(r.cost, F.lit(0.0)).alias(f"c{k}") for k, r in enumerate(rules)]
    groups = [row.asDict() | {"n": 1} for row in measured_rows.select(*flags, *costs).take(sample)]
    left, order = list(range(len(rules))), []
    while left:
        def gain(k: int) -> float:
            hits = sum(g["n"] for g in groups if g[f"r{k}"])
            return (hits + 0.5) / (sum(g[f"c{k}"] for g in groups) + 1.0)

        best = max(left, key=lambda k: (gain(k), -k))
        order.append(rules[best].name)
        left.remove(best)
        groups = [g for g in groups if not g[f"r{best}"]]
    return order


def first_rejection(rules: list[Rule], order: list[str]) -> Column:
    """Name of the first rule in order that rejects, null for a kept document. Later rules are not evaluated."""
    by_name = {r.name: r for r in rules}
    verdict = F.when(by_name[order[0]].reject, F.lit(order[0]))
    for name in order[1:]:
        verdict = verdict.when(by_name[name].reject, F.lit(name))
    return verdict


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def held(docs: DataFrame, value: Column, name: str) -> DataFrame:
    """``docs`` with ``value`` as a column that is computed once: the explode of one value keeps the optimiser
    from writing it into each expression above."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(value)).alias(name))


def cheap_measures(docs: DataFrame, name: str, text: Column) -> DataFrame:
    """``docs`` with a struct of the words and all base measures but the repeats."""
    w = fresh(docs, f"{name}_words")
    rows = docs.withColumn(w, words(text))
    return held(rows, F.struct(
        F.col(w).alias("words"), F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        symbol_count(text).alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines")), name).drop(w)


def with_repeats(docs: DataFrame, name: str, split: Column) -> DataFrame:
    """``docs`` with the number of words in repeated windows of ``split``. Each step is a column of its own,
    so that what several later ones read is computed once."""
    h, win, mask, keys, near, starts = (fresh(docs, f"{name}_{part}") for part in ("h", "win", "mask", "keys", "near", "starts"))
    steps = (
        docs.withColumn(h, F.transform(split, lambda w: F.xxhash64(w)))
        .withColumn(win, window_hashes(F.col(h)))
        .withColumn(mask, position_bits(F.col(win)))
        .withColumn(keys, sorted_keys(F.col(win), F.col(mask)))
        .withColumn(near, twins(F.col(keys), F.col(mask)))
        .withColumn(starts, repeated_starts(F.col(win), F.col(mask), F.col(near)))
    )
    return held(steps, covered(F.col(starts)), name).drop(h, win, mask, keys, near, starts)


def rules_of(docs: DataFrame, name: str, order: list[str] | None) -> tuple[DataFrame, Column]:
    """``docs`` with the cheap measures as struct ``name``, and the name of the first rule that rejects.

    ``order`` fixes the order of the rules; without it, it is estimated on the first SAMPLE_ROWS rows.
    """
    measured = cheap_measures(docs, name, F.col("text"))
    rules = standard_rules(F.col("text"), {m: F.col(f"{name}.{m}") for m in BASE[:-1]})
    return measured, first_rejection(rules, order or cascade_order(measured, rules))


def quality(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and rejected_by, for every document."""
    measured, rejected = rules_of(docs.select("doc_id", "text"), "q", order)
    rows = with_repeats(measured, "n_repeat_words", F.col("q.words"))
    n, repeated = F.col("q.n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
    rows = rows.withColumn("by", F.when(failed, "base").otherwise(rejected))
    return rows.select(
        "doc_id", *[f"q.{m}" for m in BASE[:-1]], "n_repeat_words",
        (F.coalesce(F.col("by"), F.lit("")) == "base").alias("base_failed"),
        F.col("by").isNull().alias("kept"), F.col("by").alias("rejected_by"))


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with.

    The repeats cost most, several times all other measures together, so they are looked for last, in what the other
    rules have left standing.
    """
    names, q, repeats = docs.columns, fresh(docs, "quality"), fresh(docs, "repeats")
    measured, rejected = rules_of(docs, q, order)
    standing = measured.filter((F.col(f"{q}.n_words") >= MIN_WORDS) & rejected.isNull())
    rows = with_repeats(standing, repeats, F.col(f"{q}.words"))
    return rows.filter(100 * F.col(repeats) <= MAX_REPEATED_PERCENT * F.col(f"{q}.n_words")).select(
        *[F.col(f"`{c}`") for c in names])
