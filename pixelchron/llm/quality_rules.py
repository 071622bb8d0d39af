"""Quality rules as a short-circuit cascade, ordered by what each rejects for its cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, Scratch, whole

SYMBOLS = "[#*$%&|<>]"
SPACE = "[\\x20\\x09-\\x0D]"


@dataclass
class Parts:
    """Columns that a rule may use: the text, its words and \\n-split lines, and what is counted of every text in any case."""

    text: Column
    words: Column
    lines: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column


Rule = Callable[[Parts], Column]
def parts() -> Parts:
    """The columns that text_counts makes, as rules see them."""
    return Parts(*map(F.col, ("_t", "_w", "_l", "n_words", "word_chars", "n_symbols")))


def _windows(hashes: Column) -> Column:
    """A 64-bit hash for each run of five words, from the words' hashes."""
    n = F.size(hashes)
    return F.when(n < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(5)))))


def with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds out: how many words are in five-word windows that the text has twice or more, the first included.

    Windows are compared by 64-bit hash. Most texts have no window twice, which a hash set shows at once; in the
    others windows are sorted with their places, places next to an equal are kept, and each covers five words or as many
    as there are up to the next.
    """
    df = df.withColumn("_x", F.transform(words, lambda w: F.xxhash64(w))).withColumn("_h", _windows(F.col("_x"))).drop("_x")
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.transform("_s", lambda x, k: F.when((F.get(F.col("_s"), k - 1)["h"] == x["h"]) | (F.get(F.col("_s"), k + 1)["h"] == x["h"]), x["i"]))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.filter(same, lambda x: x.isNotNull()))))
    covers = F.transform("_p", lambda x, k: F.least(F.lit(5), F.coalesce(F.get(F.col("_p"), k + 1) - x, F.lit(5))))
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.when(F.col("_p").isNull(), F.lit(0).cast("long")).otherwise(total)).drop("_h", "_s", "_p")


def text_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _t (the whole text, null as empty), _w (its words), _l (its lines), and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    The text is split once: there are as many white space characters as cuts, so words and their characters need no pass of their own.
    """
    df = df.select(F.col(id_col).alias("_id"), whole(text_col).alias("_t")).withColumn("_cut", F.split("_t", SPACE))
    df = df.select("_id", "_t", F.array_remove("_cut", "").alias("_w"), F.split("_t", "\n").alias("_l"), (F.char_length("_t") - F.size("_cut") + 1).cast("long").alias("word_chars"))
    df = df.withColumn("_full", F.filter("_l", lambda x: x.rlike(WORD)))
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"), "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long")}).drop("_full")
    df = with_repeats(df, "_w", "n_repeat_words")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def only(text: Column, others: str) -> Column:
    """How many characters of a text are left without runs of others: one match for each run, not for each character."""
    return F.char_length(F.regexp_replace(text, f"{others}++", ""))


#: What the cascade rejects besides the base rules. A rule is an expression on Parts; true rejects.
RULES: dict[str, Rule] = {
    "symbols": lambda p: 10 * p.n_symbols > 3 * p.n_words,
    "shouting": lambda p: 10 * (F.octet_length(p.text) - F.octet_length(F.replace(p.text, F.lit("!"), F.lit("")))) > 5 * p.n_words,
    "capitals": lambda p: 2 * only(p.text, "\\P{Lu}") > only(p.text, "\\P{L}"),
    "no_letters": lambda p: 2 * only(p.text, "\\P{L}") < p.word_chars,
    "few_kinds": lambda p: (p.n_words >= 50) & (10 * F.size(F.array_distinct(p.words)) < p.n_words) & (F.size(F.array_distinct(p.words)) < 40),
    "same_lines": lambda p: (F.size(p.lines) >= 5) & (2 * F.size(F.array_distinct(p.lines)) < F.size(p.lines)),
}


def greedy(costs: dict[str, float], rejected: dict[frozenset[str], int]) -> list[tuple[str, float, float]]:
    """(rule, cost, share rejected of the rows that earlier rules leave): each next rule rejects most of them for its cost, ties by name.

    rejected counts rows by the set of rules that would reject them.
    """
    left, out = dict(rejected), []
    while len(out) < len(costs):
        n = sum(left.values()) or 1
        shares = {r: sum(v for k, v in left.items() if r in k) / n for r in costs if r not in {x[0] for x in out}}
        best = min(shares, key=lambda r: (-shares[r] / costs[r], r))
        out.append((best, costs[best], shares[best]))
        left = {k: v for k, v in left.items() if best not in k}
    return out


def order_rules(df: DataFrame, rules: dict[str, Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected), as greedy orders them, measured on a sample of about sample_rows rows that pass the base rules.

    The sample is written once with its counts. A first pass tells which rules reject which rows, and compiles them; each rule's cost is then the least
    of three passes of it alone, less an empty pass. Order changes no verdict, so a timing that differs from run to run changes only what a
    run costs, and which of several rules that reject a text is named.
    """
    scratch = Scratch(df.sparkSession, "cascade")
    n = df.count()
    part = df.select(id_col, text_col).sample(min(1.0, sample_rows / max(1, n)), seed)
    part = scratch.table(text_counts(part, id_col, text_col), "sample").filter("not base_failed").coalesce(4)

    def timed(condition: Column) -> float:
        seconds = []
        for _ in range(3):
            start = time.perf_counter()
            part.agg(F.count_if(condition)).first()
            seconds.append(time.perf_counter() - start)
        return min(seconds)

    flags = F.concat_ws(",", *(F.when(rule(parts()), F.lit(name)) for name, rule in rules.items()))
    rejected = {frozenset(filter(None, r["f"].split(","))): r["count"] for r in part.groupBy(flags.alias("f")).count().collect()}
    empty = timed(F.char_length("_t") < 0)
    costs = {name: max(1e-4, timed(rule(parts())) - empty) for name, rule in rules.items()}
    scratch.drop()
    return greedy(costs, rejected)


def cascade(rules: dict[str, Rule], order: list[str]) -> Column:
    """The name of the first rule in order that rejects the text, or null: a CASE, so that later rules aren't evaluated."""
    first, *rest = order
    return reduce(lambda c, name: c.when(rules[name](parts()), F.lit(name)), rest, F.when(rules[first](parts()), F.lit(first)))


def apply_rules(df: DataFrame, rules: dict[str, Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """Per row: id, the text_counts columns, base_failed, kept, failed_rule.

    base_failed: under 10 words, or over 20 % of words in repeated five-word windows. kept: neither base_failed nor
    rejected by the cascade, which runs only where base_failed is false. failed_rule names the first of the cascade's rules that rejected;
    where several would, it depends on the order, which is measured and may differ from run to run unless order gives it. kept doesn't.
    Null text is empty and fails. Repeated and null ids are rows like others. An empty table gives an empty result.
    Other columns of df aren't read. A map over rows without a shuffle: whole texts, no Python.
    """
    rules = rules or RULES
    order = order or [name for name, _, _ in order_rules(df, rules, id_col, text_col, sample_rows)]
    out = text_counts(df, id_col, text_col).withColumn("failed_rule", F.when(~F.col("base_failed"), cascade(rules, order)))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")
