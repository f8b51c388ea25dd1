"""Quality classifier from weak labels.

Heuristic labellers vote on every document, or abstain; the votes of people (table
``labels``) are labellers too, where there are any. Expectation-maximisation over the counts
of all vote patterns estimates how each labeller votes on good and on bad documents, without
taking any of them for the truth. The posterior of each document's pattern is a soft label,
and soft labels of a bounded sample train a linear scorer on hashed words and measures, which
then judges every document by its text alone. There are two such models: junk and toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

#: Documents that the lexicon and the scorers are fitted on, about; all others count in the
#: statistics of votes and are judged.
SAMPLE = 6_000
#: Documents of the sample that must have a feature.
SUPPORT = 5
#: Bytes of the word beginnings that are features besides the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: A text is called toxic by a lexicon from this part of its words on, and clean below the other.
LEXICON_HIGH, LEXICON_LOW, LEXICON_HITS = 0.008, 0.004, 2
#: A learned insult is this many times as frequent in toxic documents.
LEXICON_LIFT = 5.0
#: Rates of words are multiplied by this, so that a notable rate is about 1.
SCALE = 50.0
#: Insults of a general word list that one labeller looks for. Fixed values.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: A learned insult has at least this likelihood ratio statistic for being more frequent in
#: toxic documents of its half of the sample; chance gives this to less than one word in a million.
LEXICON_RATIO = 25.0
#: Bounds of the measures that become features.
EDGES = {
    "symbols": (0.005, 0.01, 0.02, 0.04, 0.08, 0.15),
    "pipes": (0.01, 0.03, 0.08, 0.15, 0.3),
    "upper": (0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "bangs": (0.01, 0.05, 0.1, 0.3, 0.6),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
    "length": (2.5, 3.5, 4.5, 6.0, 8.0, 10.0, 14.0),
    "digits": (0.01, 0.05, 0.1, 0.2, 0.4),
    "stutter": (0.02, 0.1, 0.3, 0.6, 0.9),
}
MEASURES = tuple(EDGES)
INTERVALS = 8
JUNK, TOXIC = "junk", "toxic"
#: Weight of documents without votes of people, where others have them, and pseudo counts of
#: the answers abstains, good, bad for bad and for good documents.
UNSEEN = 0.05
PSEUDO_BAD, PSEUDO_GOOD = np.array([0.5, 0.5, 2.0]), np.array([0.5, 2.0, 0.05])

_WORD_BYTES = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _WORD_BYTES[_low : _high + 1] = np.arange(_low, _high + 1, dtype=np.uint8)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


@dataclass
class Described:
    """Measures of some texts, and the features of their words.

    ``n`` counts all words; ``rows`` counts the lower-case words of letters and digits before each text;
    ``word`` numbers the different ones, each with the hashes ``feats``: the whole word, then its beginnings (0 if the
    word is not longer).
    """

    m: np.ndarray
    n: np.ndarray
    rows: np.ndarray
    word: np.ndarray
    feats: np.ndarray

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.word) + 1)
        np.cumsum(of_word[self.word], out=sums[1:])
        return sums[self.rows[1:]] - sums[self.rows[:-1]]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of each text with their counts, and how many there are before each text."""
        owner = np.repeat(np.arange(len(self.rows) - 1, dtype=np.uint64), np.diff(self.rows))
        key = (owner[:, None] << np.uint64(32) | self.feats[self.word].astype(np.uint64)).ravel()
        key, count = np.unique(key[(key & np.uint64(0xFFFFFFFF)) != 0], return_counts=True)
        places = np.searchsorted(key >> np.uint64(32), np.arange(len(self.rows), dtype=np.uint64))
        return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), count.astype(np.int32), places


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows``, ``word`` and ``feats`` of some lower-case texts."""
    starts, ends, rows = common.word_spans(raw, offsets)
    hashes = common.span_hashes(raw, starts, ends)
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(first)
    at = first[order]
    feats = np.zeros((len(first), 1 + len(PREFIXES)), np.uint32)
    feats[:, 0] = (hashes[first] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for k, length in enumerate(PREFIXES):
        longer = ends[at] - starts[at] > length
        some = at[longer]
        part = common.mix(common.span_hashes(raw, starts[some], starts[some] + length) + np.uint64(length))
        feats[order[longer], k + 1] = (part >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return rows, word, feats


def described(texts: pa.Array, lowered: pa.Array) -> Iterator[Described]:
    """Runs of texts, one after the other."""
    raw, offsets = common.text_buffers(texts)
    low, low_offsets = common.text_buffers(lowered)
    for a, b in common.chunks(offsets):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, rows = common.word_spans(part, at)
        n_words = np.diff(rows)
        inside = ~common.SPACE[part]
        chars = np.maximum(1, _per_row(inside & ((part & 0xC0) != 0x80), at))
        high = np.zeros(len(part), bool)
        high[:-1] = (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)
        symbol = np.isin(part, np.frombuffer(b"#*$%&<>", np.uint8))
        alone = (ends - starts == 1) & (part[starts] == ord("|")) if len(starts) else np.zeros(0, bool)
        banged = part[ends - 1] == ord("!") if len(starts) else np.zeros(0, bool)
        hashed = common.span_hashes(part, starts, ends)
        owner = np.repeat(np.arange(b - a, dtype=np.uint64), n_words)
        order = np.unique(owner << np.uint64(40) | hashed >> np.uint64(24))
        distinct = np.diff(np.searchsorted(order >> np.uint64(40), np.arange(b - a + 1)))
        twice = np.zeros(len(starts), bool)
        if len(starts):
            twice[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
        words = np.maximum(1, n_words)
        lower, low_at = low[low_offsets[a] : low_offsets[b]], low_offsets[a : b + 1] - low_offsets[a]
        yield Described(
            np.stack(
                [
                    _per_row(symbol, at) / chars,
                    _per_row_of_words(alone, rows) / words,
                    _per_row(((part >= 0x41) & (part <= 0x5A)) | high, at) / chars,
                    _per_row_of_words(banged, rows) / words,
                    distinct / words,
                    chars / words,
                    _per_row((part >= 0x30) & (part <= 0x39), at) / chars,
                    _per_row_of_words(twice, rows) / words,
                ],
                axis=1,
            ),
            n_words, *_words(_WORD_BYTES[lower], low_at),
        )


def _per_row_of_words(mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[rows[1:]] - sums[rows[:-1]]


# ---------------------------------------------------------------- labellers


def _votes_junk(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One column per labeller: 1 bad, 0 good, -1 abstains."""

    def vote(bad, good):
        return np.where(bad, 1, np.where(good, 0, -1))

    symbols, pipes, upper, bangs, distinct, length, _, stutter = m.T
    return np.stack(
        [
            vote(symbols > 0.06, symbols < 0.03),
            vote(pipes > 0.1, pipes < 0.03),
            vote(upper > 0.5, upper < 0.25),
            vote(bangs > 0.2, bangs < 0.05),
            vote((distinct < 0.15) & (n > 30), (distinct > 0.3) | (n <= 30)),
            vote(stutter > 0.25, stutter < 0.1),
            vote((length > 12) | (length < 2.5), (length > 3) & (length < 9)),
        ],
        axis=1,
    ).astype(np.int8)


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(values.shape, bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _hash_list(words: tuple[str, ...]) -> np.ndarray:
    raw, offsets = common.text_buffers(pa.array(words))
    return np.unique(_words(raw, offsets)[2][:, 0])


def _votes_toxic(d: Described, lexica: list[np.ndarray]) -> np.ndarray:
    listed = d.per_text(_within(d.feats[:, 0], _hash_list(INSULTS)))
    words = np.maximum(1, np.diff(d.rows))
    # The list knows one language, so a text without its words may still be toxic.
    columns = [np.where(listed >= LEXICON_HITS, 1, -1)]
    for lexicon in lexica:
        hits = d.per_text(_within(d.feats, lexicon).any(axis=1))
        rate = hits / words
        vote = np.where((rate >= LEXICON_HIGH) & (hits >= LEXICON_HITS), 1, np.where(rate < LEXICON_LOW, 0, -1))
        columns.append(vote if len(lexicon) else np.full(len(hits), -1))
    return np.stack(columns, axis=1).astype(np.int8)


def estimate(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 100) -> np.ndarray:
    """Posterior of "bad" per vote pattern, by expectation-maximisation over all documents.

    Each labeller has a distribution over its three answers for good and for bad documents.
    It starts out trusting that votes mean what they say, and pseudo counts say so too. Where
    people have voted, documents that they have not seen weigh less, as they would otherwise
    explain away a labeller that finds a rare fault.
    """
    if (patterns[:, 0] >= 0).any():
        counts = np.where(patterns[:, 0] >= 0, counts, counts * UNSEEN)
    total, width = counts.sum(), patterns.shape[1]
    answers = np.stack([patterns == v for v in (-1, 0, 1)], axis=2)
    voted = (patterns >= 0).sum(axis=1)
    share = ((patterns == 1).sum(axis=1) + 0.2) / (voted + 1.0)
    posterior = np.where((patterns == 1).sum(axis=1) >= 1, np.maximum(share, 0.5), 0.05)
    # The first column is the vote of people, where there is one: it starts as near truth.
    posterior = np.where(patterns[:, 0] == 1, 0.97, np.where(patterns[:, 0] == 0, 0.03, posterior))
    for _ in range(rounds):
        bad, good = posterior * counts, (1 - posterior) * counts
        prior = (bad.sum() + 1) / (total + 2)
        logs = np.log(prior) - np.log1p(-prior)
        value = np.full(len(counts), logs)
        for k in range(width):
            p = (bad @ answers[:, k] + PSEUDO_BAD) / (bad.sum() + PSEUDO_BAD.sum())
            q = (good @ answers[:, k] + PSEUDO_GOOD) / (good.sum() + PSEUDO_GOOD.sum())
            value += answers[:, k] @ (np.log(p) - np.log(q))
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(value, -50, 50)))
        if np.abs(before - posterior).max() < 1e-6:
            break
    return posterior


# ---------------------------------------------------------------- scorer


@dataclass
class Scorer:
    """A sparse linear model: weights of word features by ascending ``keys``, of measure intervals, and a bias.

    One that was fitted to nothing finds nothing.
    """

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    measures: np.ndarray = field(default_factory=lambda: np.zeros(len(MEASURES) * INTERVALS))
    bias: float = -5.0

    def odds(self, d: Described) -> np.ndarray:
        value = self.bias + self.measures[_intervals(d.m)].sum(axis=1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, d.feats), len(self.keys) - 1)
            of_word = np.where(self.keys[at] == d.feats, self.weights[at], 0.0).sum(axis=1)
            value += SCALE * d.per_text(of_word) / np.maximum(1, np.diff(d.rows))
        return value


def _intervals(m: np.ndarray) -> np.ndarray:
    """The number of the interval that each measure is in."""
    return np.stack(
        [k * INTERVALS + np.searchsorted(np.array(EDGES[name]), m[:, k], side="right") for k, name in enumerate(MEASURES)], axis=1
    )


@dataclass
class Entries:
    """Which features the documents of a sample have: entry by entry, document after document.

    ``index`` numbers the ascending feature hashes ``keys``; ``rates`` are parts of all words.
    """

    keys: np.ndarray
    index: np.ndarray
    rates: np.ndarray
    owner: np.ndarray

    def sums(self, of_document: np.ndarray, rates: bool = False) -> np.ndarray:
        """Per feature, the sum of a value over the documents that have it, or of the value times its rate."""
        weights = of_document.astype(np.float32)[self.owner]
        return np.bincount(self.index, weights=weights * self.rates if rates else weights, minlength=len(self.keys))


def likelihood_ratio(bad: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """The statistic of features for being more frequent among bad documents than their ``share``."""
    expected = counts * share
    return np.where(bad > expected, 2 * bad * np.log(np.maximum(bad, 1e-9) / np.maximum(expected, 1e-9)), 0.0)


def fit(
    entries: Entries, intervals: np.ndarray, target: np.ndarray,
    *, ratio: float = 12.0, epochs: int = 40, l1: float = 1e-4, seed: int = 6,
) -> Scorer:
    """Logistic regression on soft labels by adaptive gradient steps with a lasso penalty.

    Of the word features, those that are notably more frequent in bad documents take part.
    """
    rows = len(target)
    if not rows:
        return Scorer()
    value = likelihood_ratio(entries.sums(target), entries.sums(np.ones(rows)), float(target.mean()))
    kept = value >= ratio
    number = np.cumsum(kept) - 1
    some = kept[entries.index]
    keys, width = entries.keys[kept], int(kept.sum())
    index, of, x = number[entries.index[some]], entries.owner[some], SCALE * entries.rates[some].astype(float)
    first = np.searchsorted(of, np.arange(rows + 1))
    total = width + len(MEASURES) * INTERVALS
    weights, square = np.zeros(total), np.full(total, 1e-6)
    base = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    bias, bias_square = float(np.log(base / (1 - base))), 1e-6
    rng = np.random.default_rng(seed)
    size = 128
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, rows, size):
            batch = order[at : at + size]
            lengths = first[batch + 1] - first[batch]
            ends = np.cumsum(lengths)
            entry = np.arange(int(ends[-1])) + np.repeat(first[batch] - ends + lengths, lengths)
            who = np.concatenate([np.repeat(np.arange(len(batch)), lengths), np.repeat(np.arange(len(batch)), len(MEASURES))])
            flat = np.concatenate([index[entry], width + intervals[batch].ravel()])
            weight_of = np.concatenate([x[entry], np.ones(len(batch) * len(MEASURES))])
            odds = bias + np.bincount(who, weights=weights[flat] * weight_of, minlength=len(batch))
            slope = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target[batch]) / len(batch)
            names, place = np.unique(flat, return_inverse=True)
            gradient = np.bincount(place, weights=slope[who] * weight_of)
            square[names] += gradient * gradient
            rate = 0.3 / np.sqrt(square[names])
            moved = weights[names] - rate * gradient
            weights[names] = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * l1)
            bias_square += slope.sum() ** 2
            bias -= 0.3 / np.sqrt(bias_square) * slope.sum()
    used = weights[:width] != 0
    return Scorer(keys[used], weights[:width][used], weights[width:], float(bias))


# ---------------------------------------------------------------- the operator


@dataclass
class Model:
    scorers: dict[str, Scorer]
    lexica: list[np.ndarray]


def _of_text(function):
    """A function of texts and lower-case texts, applied to the column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return function(text, F.lower(text))


def _people(labels: DataFrame) -> DataFrame:
    """One row per labelled document: bad if any of its rows says so; nulls say nothing."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.lit(1) - F.min("quality")).cast("int").alias("person_junk"), F.max("toxic").cast("int").alias("person_toxic")
    )


def _rate(wanted: int, there: int):
    """The part of ``1 << 24`` hash values that takes about ``wanted`` of some documents."""
    return F.lit(1 << 24 if there <= wanted else int((1 << 24) * wanted / there))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, seed: int = 6) -> Model:
    """Fit on ``doc_id, text`` and ``labels`` (``doc_id, quality, toxic``).

    The sample takes documents by a hash of their ids, about ``sample`` ids in all; their word
    hashes reach the driver, texts do not. Votes are counted over all documents. Empty tables give a model that
    keeps everything but texts without words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = rows.count()
    people = _people(labels)
    labelled = people.count()
    # Two thirds of the sample are labelled documents, if there are so many.
    parts = F.when(F.col("labelled"), _rate(sample * 2 // 3, labelled)).otherwise(_rate(sample // 3, total - labelled))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(seed)), F.lit(1 << 24))
    # Ids first: only texts of drawn documents go through a join.
    names = (
        rows.select("doc_id").distinct().join(people.withColumn("labelled", F.lit(True)), "doc_id", "left")
        .withColumn("labelled", F.coalesce("labelled", F.lit(False))).where(draw < parts)
    )
    names = common.written(names, "quality-sample")
    drawn = rows.join(F.broadcast(names.select("doc_id")), "doc_id", "left_semi")

    def describe(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lowered in pairs:
            parts = list(described(texts, lowered))
            counted = [d.counted() for d in parts]
            sizes = np.concatenate([np.diff(c[2]) for c in counted])
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            m = np.concatenate([d.m for d in parts])
            yield pa.StructArray.from_arrays(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())),
                    pa.array(np.concatenate([np.diff(d.rows) for d in parts]), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([c[0] for c in counted]).view(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([c[1] for c in counted]))),
                    pa.array(np.concatenate([_votes_text(_votes_junk(d.m, d.n)) for d in parts]), pa.string()),
                ],
                names=["m", "n", "features", "counts", "junk"],
            )

    described_by = F.arrow_udf(describe, "m array<double>, n bigint, features array<int>, counts array<int>, junk string")
    # One row per id, so that an id that many rows share brings no more than one.
    one = F.min_by("d", "k").alias("d")
    got = (
        drawn.select("doc_id", _of_text(described_by).alias("d"), F.xxhash64("text").alias("k"))
        .groupBy("doc_id").agg(one)
        .join(names, "doc_id", "left")
        .select("doc_id", "d.*", "person_junk", "person_toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"))
        .toArrow()
    )
    rows_got = got.num_rows
    order = np.lexsort((got.column("n").to_numpy(), got.column("doc_id").to_numpy()))
    lists = got.column("features").combine_chunks()
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64) if rows_got else np.zeros(0, np.int64)
    features = np.asarray(lists.flatten(), dtype=np.int32).view(np.uint32)
    kept = _common(features, rows_got)
    features = features[kept]
    counts = np.asarray(got.column("counts").combine_chunks().flatten(), dtype=np.int32)[kept]
    small = got.drop_columns(["features", "counts"]).take(order)
    del got, lists
    sizes = _sums(kept, sizes)
    places = np.append(0, np.cumsum(sizes))
    entry = _gathered(places[order], sizes[order])
    features, counts, sizes = features[entry], counts[entry], sizes[order]
    del entry, kept
    got = small.combine_chunks()
    owner = np.repeat(np.arange(rows_got, dtype=np.int32), sizes)
    rates = counts / np.maximum(1, got.column("n").to_numpy()).astype(np.float32)[owner]
    keys = np.unique(features)
    entries = Entries(keys, np.searchsorted(keys, features).astype(np.int32), rates.astype(np.float32), owner)
    del features, counts, rates
    m = np.asarray(got.column("m").combine_chunks().flatten()).reshape(rows_got, len(MEASURES))
    person = {
        JUNK: got.column("person_junk").fill_null(-1).to_numpy().astype(np.int8),
        TOXIC: got.column("person_toxic").fill_null(-1).to_numpy().astype(np.int8),
    }
    half = got.column("half").to_numpy()
    lexica = [_lexicon(entries, person[TOXIC], half == k) for k in (0, 1)]

    shared = spark.sparkContext.broadcast(lexica)

    def vote(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lowered in pairs:
            junk, toxic = [], []
            for d in described(texts, lowered):
                junk += _votes_text(_votes_junk(d.m, d.n))
                toxic += _votes_text(_votes_toxic(d, shared.value))
            yield pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (junk, toxic)], names=[JUNK, TOXIC])

    voted_by = F.arrow_udf(vote, "junk string, toxic string")
    mark = lambda c: F.when(F.col(c) == 1, "-").when(F.col(c) == 0, "+").otherwise("?")
    voted = rows.select("doc_id", _of_text(voted_by).alias("v")).select("doc_id", "v.*")
    voted = common.written(voted, "quality-votes")
    marks = [mark(f"person_{kind}") for kind in (JUNK, TOXIC)]
    counted = (
        voted.join(people, "doc_id", "left")
        .groupBy(*[F.concat(x, kind).alias(kind) for x, kind in zip(marks, (JUNK, TOXIC))])
        .count()
        .toArrow()
    )
    # Of rows that share an id, the last votes in letter order count for the sample.
    drawn_votes = voted.join(F.broadcast(names.select("doc_id")), "doc_id", "left_semi")
    drawn_votes = drawn_votes.groupBy("doc_id").agg(F.max(TOXIC).alias(TOXIC)).toArrow()
    own_toxic = dict(zip(drawn_votes.column("doc_id").to_pylist(), drawn_votes.column(TOXIC).to_pylist()))
    ids = got.column("doc_id").to_pylist()
    own = {JUNK: got.column(JUNK).to_pylist(), TOXIC: [own_toxic[i] for i in ids]}
    intervals = _intervals(m) if rows_got else np.zeros((0, len(MEASURES)), np.int64)
    scorers = {}
    for kind in (JUNK, TOXIC):
        sums = counted.group_by(kind).aggregate([("count", "sum")]).sort_by(kind)
        if not sums.num_rows:
            scorers[kind] = Scorer()
            continue
        names_of = sums.column(kind).to_pylist()
        patterns = np.array([["?+-".index(c) - 1 for c in p] for p in names_of], np.int8)
        posterior = dict(zip(names_of, estimate(patterns, sums.column("count_sum").to_numpy().astype(float)).tolist()))
        votes = ["?+-"[p + 1] + v for p, v in zip(person[kind].tolist(), own[kind])]
        scorers[kind] = fit(entries, intervals, np.array([posterior[v] for v in votes]))
    return Model(scorers, lexica)


def _common(features: np.ndarray, rows: int, support: int = SUPPORT) -> np.ndarray:
    """Which entries are of features that at least ``support`` documents have; most features are rarer."""
    keys, documents = np.unique(features, return_counts=True)
    keys = keys[documents >= min(support, rows)]
    parts = [_within(features[a : a + (1 << 19)], keys) for a in range(0, len(features), 1 << 19)]
    return np.concatenate([np.zeros(0, bool), *parts])


def _sums(kept: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many entries of each row are kept."""
    out = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(kept, (np.cumsum(sizes) - sizes)[some], dtype=np.int64)
    return out


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of entries, row after row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _votes_text(votes: np.ndarray) -> list[str]:
    """One letter per vote: ``?`` abstains, ``+`` good, ``-`` bad."""
    return ["".join("?+-"[v + 1] for v in row) for row in votes.tolist()]


def _lexicon(entries: Entries, person: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Words and beginnings that are far more frequent in what people call toxic."""
    toxic, clean = use & (person == 1), use & (person == 0)
    if not toxic.any() or not clean.any():
        return np.zeros(0, np.uint32)
    ratio = likelihood_ratio(entries.sums(toxic), entries.sums(toxic | clean), toxic.sum() / (toxic | clean).sum())
    bad, good = entries.sums(toxic, rates=True) / toxic.sum(), entries.sums(clean, rates=True) / clean.sum()
    return entries.keys[(ratio >= LEXICON_RATIO) & (bad >= LEXICON_LIFT * good)]


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``junk``, ``toxic`` (probabilities) and ``kept``, from nothing but ``text``.

    A document is kept if it has a word and both probabilities are below one half; null and
    empty texts are not kept and have junk 1. A column of ``docs`` that has one of the three
    names gives way. Repeated rows are judged each. The model is broadcast; its
    size is bound by the training sample.
    """
    scores = common.spare(docs, "scores")
    return (
        docs.withColumn(scores, _scored_by(docs, model))
        .select(*common.others(docs, JUNK, TOXIC, "kept"), f"{scores}.{JUNK}", f"{scores}.{TOXIC}")
        .withColumn("kept", (F.col(JUNK) < 0.5) & (F.col(TOXIC) < 0.5))
    )


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that ``judged`` keeps, with the columns they have."""
    scores = common.spare(docs, "scores")
    kept = (F.col(f"{scores}.{JUNK}") < 0.5) & (F.col(f"{scores}.{TOXIC}") < 0.5)
    return docs.withColumn(scores, _scored_by(docs, model)).where(kept).drop(scores)


def _scored_by(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model.scorers)

    def score(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lowered in pairs:
            out = {JUNK: [], TOXIC: []}
            for d in described(texts, lowered):
                for kind, values in out.items():
                    value = 1 / (1 + np.exp(-np.clip(shared.value[kind].odds(d), -50, 50)))
                    values.append(np.where(d.n > 0, value, float(kind == JUNK)))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))

    return _of_text(F.arrow_udf(score, "junk double, toxic double"))
