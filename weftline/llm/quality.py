"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document and leaves its measurement and one bit of ``fail_bits``.  Policies are
versioned masks over these bits, so that changing a policy, or asking what each rule costs, never reads a text again.
All of it is DataFrame expressions inside one narrow stage; nothing is shuffled except the tiny groups of an ablation.

Defined cases: a null text has no words and fails rule ``short``; an empty text likewise.  Repeated rows and null ids
are each judged by themselves, also where they tie; very long texts are measured whole, and an empty table gives no rows.
Columns other than ``doc_id`` and ``text`` play no part; clashing names are safe, as working columns are made in a projection
of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import SPACE, SPACES, let

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    #: SQL over the measures; true for a document that fails.
    fails: str


#: A rule keeps its bit for ever; a changed threshold is a new rule with a new bit.
RULES = (
    Rule("short", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("word_length", 3, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", 4, "100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", 5, "100 * n_upper > 30 * word_chars"),
    Rule("long_tail", 6, "n_words > 1000000"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


#: long_tail is measured for its ablation but no policy rejects by it: a long text is not a bad text.
POLICIES = {
    "base": Policy("base", ("short", "repeated_windows")),
    "v1": Policy("v1", ("short", "repeated_windows", "symbols", "word_length", "repeated_lines", "shouting")),
}


def repeated_words(words: Column, n_words: Column) -> Column:
    """Words inside 3-word windows whose words occur as a window twice or more in the array, the first one included.

    Each window becomes one long: its hash in the high bits, its position in the low ones.  Sorting brings equal
    windows together, neighbours are compared word by word (so that a hash collision adds nothing), and the sorted
    positions of repeated windows give the size of their union.  n log n for each text, whatever it repeats.  A repeat
    would be missed only if a window of other words, with the same high bits (44 and more for texts of under a million
    words), stood between the two.
    """
    bits = F.length(F.bin(n_words))
    left, right = partial(F.call_function, "shiftleft"), partial(F.call_function, "shiftrightunsigned")
    low = F.lit(1).cast("long")

    def counted(packed: Column, shift: Column) -> Column:
        place = lambda x: x.bitwiseAND(left(low, shift) - 1).cast("int")
        same = lambda a, b: (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))
        twin = lambda x, y: y.isNotNull() & (right(x, shift) == right(y, shift)) & same(place(x), place(y))
        again = F.filter(packed, lambda x, i: F.coalesce(twin(x, F.get(packed, i - 1)), F.lit(False)) | F.coalesce(twin(x, F.get(packed, i + 1)), F.lit(False)))
        starts = F.array_sort(F.transform(again, lambda x: place(x).cast("long")))
        step = F.aggregate(
            starts,
            F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n")),
        )
        return step["n"]

    windows = F.transform(
        F.sequence(F.lit(0), n_words - 3),
        lambda i: left(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")),
    )
    return F.when(n_words < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), lambda p: counted(p, bits)))


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all by default, in a struct ``row``) with every measure."""
    whole = F.coalesce(F.col(text), F.lit(""))
    taken = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), whole.alias("t"))
    split = taken.select("row", "t", F.filter(F.split("t", SPACE, -1), lambda w: w != "").alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    counted = split.select("row", "t", "w", F.size("w").alias("n"), lines.alias("l"))
    return counted.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), F.col("n")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), the measures and ``fail_bits``: bit b is set if the rule of bit b failed."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text, keep).select("row", *MEASURES, bits.alias("fail_bits"))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy].mask)) == 0


def filtered(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns only."""
    # a row number that the filter reads keeps the filter above the measures; pushed below, it would measure again and again
    judged = ledger(docs, text).select("row", passes(policy).alias("_keep"), F.monotonically_increasing_id().alias("_n"))
    return judged.where(F.col("_keep") & (F.col("_n") >= 0)).select("row.*")


def ablation(ledgers: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail nothing else of the policy, and would be kept without
    it.  The ledger is first counted by its bits, of which there are at most 2 ** rules, and never by text."""
    mask, chosen = POLICIES[policy].mask, [r for r in RULES if r.name in POLICIES[policy].rules]
    by_bits = ledgers.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    each = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        zero(hit).alias("n_fail"),
        zero(alone).alias("n_only"),
        (zero(F.col("bits") == 0) + zero(alone)).alias("n_kept_without"),
        F.coalesce(F.expr("bit_or(CASE WHEN (bits & bit) <> 0 THEN bits ELSE 0L END)"), F.lit(0).cast("long")).alias("seen_with"),
    )
