"""Quality rules with risk-controlled thresholds, with DataFrame operations alone.

Fixed base rules come first. Beyond them every rule has a chain of cutoffs from lax to strict. For
each stratum the labelled documents tell how many good ones a cutoff would reject; an exact binomial
test says whether that proves a false-rejection rate below the rule's share of the allowed one. The
allowed rate is shared among the rules, so all rules together stay below it. The error level is
shared among all (stratum, rule) chains (Bonferroni), and each chain is tested in its fixed order and
ends at the first failure, so no further correction is needed within it. Of the certified cutoffs the
one that gains most takes effect; a stratum with too few labels certifies nothing and loses nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pinwatch.llm.names import plain, spare
from pinwatch.session import stored_table

#: White space between words, as a pattern and as characters.
SPACE_PATTERN, SPACE_CHARS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SYMBOL_PATTERN = r"[^#*$%&|<>]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Rejects where ``100 * numerator > cutoff * denominator``; cutoffs from lax to strict."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[int, ...]

    def rejects(self, cutoff) -> Column:
        return 100 * F.col(self.numerator) > cutoff * F.col(self.denominator)


RULES = (
    Rule("symbols", "n_symbols", "n_words", (300, 200, 100, 50, 25, 10)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (80, 60, 50, 40, 30, 20)),
    Rule("repeated_words", "n_repeat_words", "n_words", (18, 15, 12, 10, 8, 5)),
    Rule("word_length", "word_chars", "n_words", (2000, 1500, 1200, 1000, 900, 800)),
)
ALLOWED_RATE, ERROR_LEVEL = 0.02, 0.05
#: A wrongly rejected good document weighs as many rightly rejected ones.
GOOD_WEIGHT = 10


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows of five that occur more than once."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeats(ordered: Column) -> Column:
        near = lambda e, j: F.get(ordered, j)["h"] == e["h"]
        place = lambda e, j: F.when(near(e, j - 1) | near(e, j + 1), e["p"])
        return _let(F.array_sort(F.array_compact(F.transform(ordered, place))), covered)

    def count(windows: Column) -> Column:
        pairs = F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        several = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(several, _let(F.array_sort(pairs), repeats)).otherwise(0)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, WINDOW)]))

    return _let(hashes, lambda h: F.when(F.size(h) > WINDOW, _let(windows(h), count)).otherwise(0))


def signals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum: str | None = "lang") -> DataFrame:
    """Counts per document: ``doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words``, and ``text_mark``, a hash of the text. Null texts count as empty; empty ones have
    zero of everything. A null stratum is one of its own. Other columns are not read."""
    text = F.coalesce(docs[text_column], F.lit(""))
    group = F.coalesce(docs[stratum].cast("string"), F.lit("")) if stratum else F.lit("")
    base = docs.select(
        docs[id_column].cast("long").alias("doc_id"), group.alias("stratum"), text.alias("text"), F.xxhash64(text).alias("text_mark")
    )
    trimmed = F.btrim("text", F.lit(SPACE_CHARS))
    # Hashes of words stand for the words: equal ones in one document are equal words.
    hashes = F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(trimmed, SPACE_PATTERN), lambda w: F.xxhash64(w))
    )
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    counted = base.select(
        "doc_id", "stratum", "text_mark", hashes.alias("hashes"), lines.alias("lines"),
        F.length(F.regexp_replace("text", SPACE_PATTERN, "")).alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOL_PATTERN, "")).alias("n_symbols"),
    )
    return counted.select(
        "doc_id", "stratum", "text_mark", F.size("hashes").cast("long").alias("n_words"), F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def most_errors(n: Column, rate: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, rate) <= k) <= level, or -1: so few errors among n prove a rate
    below ``rate``. The terms follow from each other in logarithms, so that large n don't underflow."""
    odds = math.log(rate / (1 - rate))
    start = F.struct((n * math.log1p(-rate)).alias("term"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("k"))

    def step(state: Column, i: Column) -> Column:
        total = state["total"] + F.exp(state["term"])
        nxt = state["term"] + F.log((n - i) / (i + 1)) + odds
        return F.struct(nxt.alias("term"), total.alias("total"), F.when(total <= level, i).otherwise(state["k"]).alias("k"))

    reach = F.sequence(F.lit(0).cast("long"), F.floor(n * rate).cast("long"))
    return F.aggregate(reach, start, step, lambda state: state["k"])


def certified_cutoffs(
    counts: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES,
    allowed: float = ALLOWED_RATE, level: float = ERROR_LEVEL, good_weight: int = GOOD_WEIGHT,
) -> DataFrame:
    """``stratum, rule, cutoff``: the cutoffs that take effect, from all labelled documents.

    ``counts`` has the columns of :func:`signals`; ``labels`` has ``doc_id, quality``. A document labelled
    more than once counts as bad if any label says so; null labels and ids are passed over. Documents
    that fail the base rules are no part of the holdout, as these rules never see them.
    """
    graded = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    graded = graded.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    holdout = counts.filter(~base_failed()).join(graded, "doc_id")
    number = lambda condition: F.sum(condition.cast("long"))
    tests = [(r, c, place) for r in rules for place, c in enumerate(r.cutoffs)]
    per_stratum = holdout.groupBy("stratum").agg(
        number(F.col("good")).alias("n_good"),
        *[number(F.col("good") & r.rejects(c)).alias(f"g_{r.name}_{c}") for r, c, _ in tests],
        *[number(~F.col("good") & r.rejects(c)).alias(f"b_{r.name}_{c}") for r, c, _ in tests],
    )
    chains = len(rules) * F.count("*").over(_everything())
    bounded = per_stratum.withColumn("level", level / chains).withColumn(
        "most", most_errors(F.col("n_good"), allowed / len(rules), F.col("level"))
    )
    cell = lambda r, c, place: F.struct(
        F.lit(r.name).alias("rule"), F.lit(place).alias("place"), F.lit(c).alias("cutoff"),
        F.col(f"g_{r.name}_{c}").alias("wrong"), F.col(f"b_{r.name}_{c}").alias("right"),
    )
    cells = bounded.select("stratum", "most", F.inline(F.array(*[cell(*t) for t in tests])))
    # Cutoffs of a rule are nested, so wrong rejections only grow along a chain: a cutoff passes exactly
    # if it and all laxer ones do.
    passing = cells.filter("wrong <= most").withColumn("gain", F.col("right") - good_weight * F.col("wrong"))
    best = passing.groupBy("stratum", "rule").agg(F.max(F.struct("gain", -F.col("place"), "cutoff")).alias("best"))
    return best.filter("best.gain > 0").select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def _everything():
    """A window over strata, of which there are few."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def judge(counts: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counts`` with ``base_failed`` and ``kept``. ``cutoffs`` has one row per stratum and rule."""
    wide = cutoffs.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in rules]
    )
    wide = stored_table(wide, "quality-cutoffs")  # its size is known, so Spark knows whether to broadcast it
    rejected = F.lit(False)
    for r in rules:
        rejected |= F.coalesce(r.rejects(F.col(f"cut_{r.name}")), F.lit(False))
    failed = counts.join(wide, "stratum", "left").withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*[f"cut_{r.name}" for r in rules])


def quality_rules(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules; texts of any length are counted whole. A null
    stratum is one of its own, null ids have no label. Rows that share an id share its label and are
    judged each by its own text; of cutoffs with equal gain the strictest listed first is taken. An empty
    table gives no rows; without labels nothing is certified and only the base rules reject. Other columns
    are not read.
    """
    counts = stored_table(signals(docs, **columns), "quality-signals")
    return judge(counts, certified_cutoffs(counts, labels))


def passing_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns.

    Verdicts are matched by id, stratum and a hash of the text, on which alone they depend, so rows that
    share an id or a text are each judged by their own and copies are spread by their ids. Repeated rows all
    stay or all go; an empty table stays empty.
    """
    verdicts = quality_rules(docs, labels, id_column=id_column, text_column=text_column, stratum=stratum)
    own = [spare(name, docs.columns) for name in ("id", "no_id", "stratum", "mark")]

    def keys(number, group, mark):
        values = (F.coalesce(number, F.lit(0)), number.isNull(), group, mark)
        return [value.alias(name) for value, name in zip(values, own, strict=True)]

    passing = verdicts.filter("kept").select(*keys(F.col("doc_id"), F.col("stratum"), F.col("text_mark"))).distinct()
    text = F.coalesce(docs[text_column], F.lit(""))
    group = F.coalesce(docs[stratum].cast("string"), F.lit(""))
    marked = docs.select("*", *keys(docs[id_column].cast("long"), group, F.xxhash64(text)))
    return marked.join(passing, own, "left_semi").select(*plain(docs))
