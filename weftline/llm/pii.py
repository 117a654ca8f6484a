"""Personal data: spans of fixed patterns, and more by bootstrapping from their contexts.

The four base kinds are regular expressions with checks.  Their matches are the seeds.  The word before a seed, a label that is
glued to it (``tel:+49...``), and the word after it are lexical patterns; patterns and the identifier-like words that stand in
them (instances) form a graph whose scores Spark computes in rounds:

* a pattern scores the share of all occurrences of its word in the corpus that stand beside a known instance, so that a common
  word, though it often stands by a seed by chance, scores next to nothing;
* an unseen instance scores 1 - prod(1 - score of its patterns).

Instances that reach ``accept`` through patterns seen with ``min_support`` different instances are spans of kind ``other``.

An instance is a word with a digit, an @ between letters, or (at), of at least ``min_length`` characters between its outer
letters and digits, apart from base spans.  A label is 3 to 24 letters at the start of a word and a colon or equals sign.
Instances of one word and patterns of one word beside it are all that is learned.

Everything is DataFrame functions.  Positions of matches are running sums of the lengths of the matches and of what lies
between them, taken block by block, so that time grows in proportion to a text and its matches.  Quantifiers are possessive
and matches start where a run of their characters starts, which leaves the matches as they are and keeps a very long run
linear and off the stack.

Defined cases: a null text counts as empty and stays null when redacted; repeated rows and null ids are searched one by one;
very long texts are searched whole; instances that tie are all found; an empty table gives no rows.  Carried columns may have
any names, as they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import let, written

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
#: Each with what a match must start after: no character of its first run, or the last match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?+"
GAP, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
LABEL = rf"(?<!{WORD})\p{{L}}{{3,24}}+[:=]"
AFTER_LABEL = rf"(?<=[:=])(?<=(?<!{WORD})\p{{L}}{{3,24}}[:=])"
#: A word begins after white space or a glued label, which is a word of its own.
BEGIN = rf"(?:(?<!{WORD})(?!{LABEL}{WORD})|{AFTER_LABEL})"
CANDIDATE = rf"{BEGIN}(?={WORD}*?(?:[0-9]|\p{{L}}@\p{{L}}|\(at\))){WORD}++"
SPLIT = rf"{GAP}++|{AFTER_LABEL}(?={WORD})"
#: The last word of what lies before a match, punctuation between them aside; the first of what lies after it.
BEFORE = rf"{BEGIN}({WORD}++){GAP}++[^\p{{L}}0-9\x20\x09-\x0D]*+$"
GLUED = rf"({LABEL})[^\p{{L}}0-9\x20\x09-\x0D]*+$"
AFTER = rf"^[^\p{{L}}0-9\x20\x09-\x0D]*+{GAP}++({LABEL}(?={WORD})|{WORD}++)"
SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
INTS = "array<int>"
SALTS, BLOCK = 8, 64
#: Tables of at most so many short rows are broadcast; larger ones are joined by shuffle.
SMALL = 20_000


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """An array's merged values up to each place, as SQL's running windows have them.  Appending to an array copies it, so it
    is done in blocks, and then over the blocks' ends."""

    def folded(xs: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(xs, F.array(zero), lambda s, x: F.concat(s, F.array(merge(F.element_at(s, -1), value(x)))))

    blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(values) - 1, F.lit(BLOCK)).cast("int")), lambda k: folded(F.slice(values, k * BLOCK + 1, F.lit(BLOCK)), lambda x: x))

    def whole(parts: Column) -> Column:
        ends = folded(parts, lambda p: F.element_at(p, -1))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, 2, BLOCK), lambda x: merge(F.get(e, k), x)))))

    return F.when(F.size(values) > 0, let(blocks, whole)).otherwise(F.array().cast(INTS))


def sums(values: Column) -> Column:
    return running(values, F.lit(0), lambda a, b: a + b)


def maxima(values: Column) -> Column:
    return running(values, F.lit(0), lambda a, b: F.greatest(a, b))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _validator(kind: str):
    return lambda x: _valid(kind, x["value"])


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Every leftmost match with its place in code points, and the words before and after it."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def before(gap: Column) -> Column:
        word = F.regexp_extract(gap, BEFORE, 1)
        return F.lower(F.when(word != "", word).otherwise(F.regexp_extract(gap, GLUED, 1)))

    def placed(gap: Column, hit: Column, ends: Column) -> Column:
        span = lambda h, i: F.struct(F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("value"), before(F.get(gap, i)).alias("before"), F.lower(F.regexp_extract(F.get(gap, i + 1), AFTER, 1)).alias("after"))
        return F.transform(hit, span)

    steps = lambda gap, hit: F.transform(hit, lambda h, i: F.length(F.get(gap, i)) + F.length(h))
    found = let(gaps, lambda g: let(hits, lambda h: let(steps(g, h), lambda s: let(sums(s), lambda ends: placed(g, h, ends)))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All valid base spans of a text by kind as listed, then start.  Texts without the first needed character are not
    searched."""
    needs = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    found = []
    for kind in KINDS:
        spans = F.filter(_matches(text, PATTERNS[kind], kind), _validator(kind))
        may = text.rlike("[0-9]") if kind != "email" else F.lit(True)
        may = may & F.contains(text, F.lit(needs[kind])) if needs[kind] else may
        found.append(F.when(may, spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


def candidates(text: Column, min_length: int = 6) -> Column:
    """Identifier-like words, trimmed to their outer letters and digits."""
    edge = r"^[^\p{L}0-9]*+"
    core = lambda x: F.regexp_extract(x["value"], r"(?s)[\p{L}0-9](?:.*[\p{L}0-9])?", 0)
    start = lambda x: x["start"] + F.length(F.regexp_extract(x["value"], edge, 0))
    cut = lambda x: F.struct(F.lit(OTHER).alias("kind"), start(x).alias("start"), (start(x) + F.length(core(x))).alias("end"), core(x).alias("value"), x["before"].alias("before"), x["after"].alias("after"))
    long = F.filter(F.transform(_matches(text, CANDIDATE, OTHER), cut), lambda x: F.length(x["value"]) >= min_length)
    return F.when(text.rlike(r"[0-9@]|\(at\)"), long).otherwise(F.array().cast(SPAN))


def apart(free: Column, base: Column) -> Column:
    """The spans of free that touch none of base: both are put in one order, and the greatest end before and the least start
    after each place decide."""
    last = (1 << 31) - 1
    own = F.transform(free, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("of")))
    theirs = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(-1).alias("of")))
    ends = lambda e: maxima(F.transform(e, lambda x: F.when(x["of"] < 0, x["end"]).otherwise(0)))
    # the least start from here on, as the greatest of what is left of the range, from the last place back
    starts = lambda e: maxima(F.transform(F.reverse(e), lambda x: F.when(x["of"] < 0, F.lit(last) - x["start"]).otherwise(0)))

    def kept(e: Column, before: Column, after: Column) -> Column:
        lone = F.filter(e, lambda x, i: (x["of"] >= 0) & (F.get(before, i) <= x["start"]) & (F.lit(last) - F.get(after, F.size(e) - 1 - i) >= x["end"]))
        return F.transform(lone, lambda x: F.get(free, x["of"]))

    merged = let(F.array_sort(F.concat(own, theirs)), lambda e: let(ends(e), lambda b: let(starts(e), lambda a: kept(e, b, a))))
    return F.when((F.size(base) > 0) & (F.size(free) > 0), merged).otherwise(free)


def mentions(docs: DataFrame, text: str = "text", carry: list[str] | None = None, min_length: int = 6) -> DataFrame:
    """rid, row (the carried columns), base and other (candidates outside base spans) for each row, as a written table."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row")
    seen = docs.select(row, whole.alias("t")).select("row", base_spans(F.col("t")).alias("base"), candidates(F.col("t"), min_length).alias("free"))
    return written(seen.select(F.monotonically_increasing_id().alias("rid"), "row", "base", apart(F.col("free"), F.col("base")).alias("other")), "mentions")


def _totals(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(word, total): how often each pattern's word occurs in all texts, beside anything."""
    words = docs.select(F.explode(F.split(F.lower(F.col(f"`{text}`")), SPLIT, -1)).alias("word"))
    if patterns.count() <= SMALL:
        words = words.join(F.broadcast(patterns), "word", "left_semi")
        return words.groupBy("word").agg(F.count("*").alias("total"))
    return words.groupBy("word").agg(F.count("*").alias("total")).join(patterns, "word", "left_semi")


def discovered(docs: DataFrame, seen: DataFrame, text: str = "text", rounds: int = 3, min_support: int = 3, accept: float = 0.5) -> DataFrame:
    """(value, score): the identifiers that confident patterns give away, lower case, after so many rounds."""
    contexts = F.explode(F.filter(F.array(F.concat(F.lit("<"), "m.before"), F.concat(F.lit(">"), "m.after")), lambda x: F.length(x) > 1))
    each = seen.select(F.explode(F.concat("base", "other")).alias("m")).select(contexts.alias("pattern"), F.lower("m.value").alias("value"), (F.col("m.kind") != OTHER).cast("double").alias("seed"))
    edges = written(each.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    seeded = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("seed").alias("seeds")).where((F.col("values") >= min_support) & (F.col("values") > F.col("seeds")))
    word = F.expr("substring(pattern, 2)")
    patterns = written(seeded.select("pattern", word.alias("word")), "patterns")
    totals = patterns.join(_totals(docs, text, patterns.select("word").distinct()), "word").select("pattern", "total")
    graph = written(edges.join(totals, "pattern"), "graph")
    known = graph.select("value", F.col("seed").alias("score")).groupBy("value").agg(F.max("score").alias("score"))
    for _ in range(rounds):
        scored = graph.join(known, "value")
        pattern = scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.first("total")).alias("p"), F.count(F.when(F.col("score") >= accept, 1)).alias("support"))
        pattern = pattern.where(F.col("support") >= min_support).select("pattern", F.least("p", F.lit(1.0)).alias("p"))
        doubt = F.exp(F.sum(F.log1p(-F.least(F.coalesce("p", F.lit(0.0)), F.lit(0.999999)))))  # no pattern says nothing
        known = graph.join(pattern, "pattern", "left").groupBy("value").agg(F.greatest(F.max("seed"), 1 - doubt).alias("score"), F.max("seed").alias("seed"))
        known = written(known, "known").select("value", "score", "seed")
        last, known = known, known.select("value", "score")
    return last.where((F.col("seed") == 0) & (F.col("score") >= accept)).select("value", "score")


def personal(docs: DataFrame, text: str = "text", carry: list[str] | None = None, min_length: int = 6, **options) -> DataFrame:
    """row (the carried columns), base and other: the spans of each row of docs."""
    seen = mentions(docs, text, carry, min_length)
    new = discovered(docs, seen, text, **options)
    salted = new.select(F.col("value").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    free = seen.where(F.size("other") > 0).select("rid", F.explode("other").alias("m")).withColumn("s", F.pmod(F.hash("rid"), F.lit(SALTS)))
    met = free.join(salted, (F.lower("m.value") == F.col("key")) & (free.s == salted.s)).select("rid", "m")
    order = ("start", "end", "value", "before", "after")
    spans = written(met.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(*[f"m.{c}" for c in order]))).alias("more")), "discovered")
    spans = F.broadcast(spans) if spans.count() <= SMALL else spans
    other = F.transform("more", lambda x: F.struct(F.lit(OTHER).alias("kind"), *[x[c].alias(c) for c in order]))
    return seen.drop("other").join(spans, "rid", "left").select("row", "base", F.coalesce(other, F.array().cast(SPAN)).alias("other"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", length: str | None = None, **options) -> DataFrame:
    """The rows of docs with each span of personal data replaced by its kind in brackets; overlapping spans become one, named
    by the first.  length names a column that holds the text's length and is kept right.  A null text stays null."""
    found = personal(docs, text, **options)
    spans = F.array_sort(F.transform(F.concat("base", "other"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    t = F.col(f"row.`{text}`")

    def cleaned(spans: Column, reach: Column, code: Column) -> Column:
        # in four bytes for each character a part is found without reading what lies before it
        part = lambda a, b: F.decode(F.substring(code, 4 * a + 1, 4 * (b - a)), "UTF-32")
        until = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
        pieces = F.transform(spans, lambda x, i: F.when(x["start"] >= until(i), F.concat(part(until(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(reach, -1), F.call_function("div", F.octet_length(code), F.lit(4)).cast("int")))

    reach = lambda s: maxima(F.transform(s, lambda x: x["end"]))
    clean = let(spans, lambda s: let(reach(s), lambda r: let(F.encode(t, "UTF-32"), lambda code: cleaned(s, r, code))))
    done = found.select("row", F.when(F.size("base") + F.size("other") > 0, clean).otherwise(t).alias("clean"))
    swap = {text: F.col("clean")} | ({length: F.length("clean").cast(docs.schema[length].dataType)} if length else {})
    return done.select(*[swap.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
