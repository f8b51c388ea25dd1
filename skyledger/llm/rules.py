"""Quality rules whose cutoffs are chosen with a guaranteed bound on false rejections.

Everything is DataFrame and SQL functions. The measures of a text are array expressions
inside its row; nothing of a text is shuffled. For every stratum, rule and cutoff, the holdout
counts how many good documents the cutoff would reject. A cutoff is allowed only if the
exact binomial test rejects "the false rejection rate is above the limit" at a level that is
divided among all strata, rules and cutoffs (Bonferroni). Each stratum starts with the strictest
allowed cutoff per rule. A text goes if any rule rejects it, so the same test then holds the good documents that
any rule rejects against the limit, at the level of the single tests; cutoffs are loosened until it is passed.
The choice follows from the same holdout, and the level is not divided among all choices of cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

SYMBOLS = r"[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]+"
#: Limit of the false rejection rate per stratum, for each rule and for all together, and error level of all tests.
RISK, LEVEL = 0.05, 0.05
#: Cutoffs that are tried, from the strictest on; a text is rejected above its cutoff.
CUTOFFS = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "upper_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "long_words": (8.0, 9.0, 10.0, 12.0, 15.0),
}
MIN_WORDS = 50


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that occurs again in the text.

    A window is one long: as many bits of its hash as the bits of the last place leave free,
    then its place. Sorted, equal windows are neighbours; the places of windows that have an
    equal neighbour, sorted again, give the words they cover. All steps take n log n.
    """
    n = F.size(words)
    last = n - width

    def with_bits(bits):
        packed = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.call_function("shiftleft", F.xxhash64(*[F.get(words, i + k) for k in range(width)]), bits)
            .bitwiseOR(i.cast("bigint")),
        )
        return _bind(F.sort_array(packed), lambda s: places(s, bits))

    def places(s, bits):
        mask = (F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("bigint")
        following = F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))
        twins = F.zip_with(
            s, following,
            lambda a, b: F.when(
                F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits),
                F.array(a.bitwiseAND(mask), b.bitwiseAND(mask)),
            ),
        )
        found = F.flatten(F.filter(twins, lambda x: x.isNotNull()))
        return _bind(F.sort_array(F.array_distinct(found)), covered)

    def covered(p):
        following = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
        steps = F.zip_with(p, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)).cast("bigint"))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    bits = F.length(F.bin(last.cast("bigint")))
    return F.when(n > width, _bind(bits, with_bits)).otherwise(F.lit(0)).cast("bigint")


def measured(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id``, the carried columns, and the measures of each whole text.

    A null text has no words. Each measure is one expression per row; words of a row are
    split once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(common.WORD))
    stats = _bind(
        words,
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    return (
        docs.select(
            "doc_id", *carried,
            stats.alias("s"),
            F.length(F.regexp_replace(text, BLANK, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _bind(lines, lambda x: F.size(x)).cast("bigint").alias("n_lines"),
            (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("bigint").alias("n_upper"),
        )
        .select("doc_id", *carried, "s.n_words", "word_chars", "n_symbols", "n_dup_lines", "s.n_repeat_words", "n_lines", "n_upper")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


RULES = {
    "symbol_share": lambda: _share("n_symbols", "word_chars"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    "upper_share": lambda: _share("n_upper", "word_chars"),
    "long_words": lambda: _share("word_chars", "n_words"),
}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), by a running sum of logarithms of its terms."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, step, lambda acc: acc["total"]))


def cutoffs(holdout: DataFrame, *, risk: float = RISK, level: float = LEVEL, grid: dict = CUTOFFS) -> DataFrame:
    """``stratum, rule, cutoff``: strict cutoffs that together keep the risk, of each stratum and rule.

    ``holdout`` has ``stratum`` and one column per rule, one row per good document that the
    base rules keep. A stratum without enough good documents gets no cutoff, and its rule
    rejects nothing. The counts are one aggregate with a row per stratum.
    """
    counts = common.written(holdout.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(F.col(rule) > c).alias(f"{rule}_{i}")
            for rule, values in grid.items()
            for i, c in enumerate(values)
        ],
    ), "quality-counts")
    tests = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}_{i}").alias("k"))
            for rule, values in grid.items()
            for i, c in enumerate(values)
        ]
    )
    each = counts.select("stratum", "n", F.inline(tests))
    hypotheses = max(1, counts.count()) * sum(map(len, grid.values()))
    alone = (
        each.where(
            (F.col("k") <= F.col("n") * risk) & (binomial_tail(F.col("k"), F.col("n"), risk) <= level / hypotheses)
        )
        .groupBy("stratum", "rule")
        .agg(F.min("cutoff").alias("cutoff"))
    )
    return _together(holdout, alone, risk, level / hypotheses, grid)


def _together(holdout: DataFrame, alone: DataFrame, risk: float, level: float, grid: dict) -> DataFrame:
    """Cutoffs loosened until the good documents that any rule rejects keep the risk in each stratum.

    A document is, per rule, the number of cutoffs that it is above. Equal ones are counted once, so what is
    worked on has a row per stratum and choice of cutoffs at most. A rule's choice is the place of its cutoff, or
    the number of cutoffs where it rejects nothing. Each round moves one rule of a stratum that fails to its next cutoff,
    the one that saves most documents, or else the one that rejects most.
    """
    above = {
        rule: F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(values)]), lambda c: F.col(rule) > c))
        for rule, values in grid.items()
    }
    cells = common.written(
        holdout.select("stratum", *[x.alias(rule) for rule, x in above.items()])
        .groupBy("stratum", *grid).agg(F.count(F.lit(1)).alias("n")),
        "quality-cells",
    )
    place = {
        rule: F.coalesce(
            F.min(F.when(F.col("rule") == rule, F.array_position(F.array(*[F.lit(float(c)) for c in sorted(values)]), F.col("cutoff")) - 1)),
            F.lit(len(values)),
        ).cast("int")
        for rule, values in grid.items()
    }
    chosen = common.written(alone.groupBy("stratum").agg(*[x.alias(f"at_{rule}") for rule, x in place.items()]), "quality-chosen")
    settled = []
    while True:
        def rejected(looser=None):
            # A document above j cutoffs is rejected by each of the j strictest.
            hits = [F.col(rule) > F.col(f"at_{rule}") + F.lit(int(rule == looser)) for rule in grid]
            any_hit = hits[0]
            for hit in hits[1:]:
                any_hit = any_hit | hit
            return F.coalesce(F.sum(F.when(any_hit, F.col("n"))), F.lit(0))

        tested = common.written(
            cells.join(chosen, "stratum").groupBy("stratum", *[f"at_{rule}" for rule in grid]).agg(
                F.sum("n").alias("n"), rejected().alias("k"),
                *[rejected(rule).alias(f"k_{rule}") for rule in grid],
                *[F.coalesce(F.sum(F.when(F.col(rule) > F.col(f"at_{rule}"), F.col("n"))), F.lit(0)).alias(f"own_{rule}") for rule in grid],
            ),
            "quality-tested",
        )
        passed = (F.col("k") <= F.col("n") * risk) & (binomial_tail(F.col("k"), F.col("n"), risk) <= level)
        settled.append(tested.where(passed))
        failed = tested.where(~passed)
        if failed.isEmpty():
            break
        # Rules without a cutoff left cannot be loosened; a stratum without any rule rejects nothing and is gone.
        moves = F.array_max(F.array(*[
            F.when(
                F.col(f"at_{rule}") < len(values),
                F.struct((-F.col(f"k_{rule}")).alias("saved"), F.col(f"own_{rule}").alias("own"), F.lit(rule).alias("rule")),
            )
            for rule, values in grid.items()
        ]))
        left = F.lit(False)
        for rule, values in grid.items():
            left = left | (F.col(f"at_{rule}") < len(values))
        chosen = common.written(
            failed.withColumn("move", moves["rule"])
            .select("stratum", *[(F.col(f"at_{rule}") + (F.col("move") == rule).cast("int")).alias(f"at_{rule}") for rule in grid])
            .where(left),
            "quality-chosen",
        )
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    places = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.get(F.array(*[F.lit(float(c)) for c in sorted(values)]), F.col(f"at_{rule}")).alias("cutoff"))
        for rule, values in grid.items()
    ])
    return found.select("stratum", F.inline(places)).where("cutoff IS NOT NULL")


def judged(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", max_strata: int = 100_000, **options) -> DataFrame:
    """All measures of every document, ``base_failed``, ``rejected_by`` and ``kept``.

    ``labels`` (``doc_id, quality``) marks good documents by quality 1; rows of one document
    that disagree count as not good, labels without a document and null qualities count not at all. A null stratum is a
    stratum. Repeated rows are judged each. Without labels no rule has a cutoff, and the base
    rules alone decide. The cutoffs have one row per stratum, whose number is checked to be
    at most ``max_strata`` before they are broadcast; beyond that they are joined by a shuffle.
    """
    # Written once: the measures cost most, and both the holdout and the verdict need them.
    key = F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n"))
    rows = common.written(
        measured(docs.withColumn("stratum", key), "stratum").withColumns({k: v() for k, v in RULES.items()}), "quality-measures"
    )
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    holdout = rows.where("NOT base_failed").select("doc_id", "stratum", *RULES).join(good, "doc_id")
    wide = (
        cutoffs(holdout, **options)
        .groupBy("stratum")
        .agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"{rule}_cutoff") for rule in RULES])
    )
    wide = common.written(wide, "quality-cutoffs")
    small = wide.limit(max_strata + 1).count() <= max_strata
    broken = F.array_compact(F.array(*[F.when(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(rule)) for rule in RULES]))
    return (
        rows.join(F.broadcast(wide) if small else wide, "stratum", "left")
        .withColumn("rejected_by", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    )
