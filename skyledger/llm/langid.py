"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

Training counts hashed letter n-grams per language over all training texts. A document is a
mixture of languages; its proportions are estimated by expectation-maximisation from the
likelihoods of its n-grams, for a set of languages that grows as long as the penalised likelihood
(Bayesian information criterion) rises.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

#: Hash values of an n-gram, letters per n-gram.
BUCKETS, NGRAM = 1 << 15, 3
#: Steps per set at most, how far below its top a log likelihood may stay, and the weight of unseen n-grams.
STEPS, SLACK, PSEUDO = 500, 0.01, 0.5
#: Beyond this many languages the model does not fit a task, and training refuses.
MODEL_LANGUAGES = 1000
#: Code points that are worked on at once.
POINTS = 1 << 19
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def ngram_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: text number, n-gram and how often, sorted by text number.

    Texts are lower-cased; each run of other characters than letters counts as one space.
    N-grams with two spaces around one place or none of them letters do not arise.
    """
    at = 0
    while at < len(texts):
        size, last = 0, at
        while last < len(texts) and (last == at or size + len(texts[last]) <= POINTS) and last - at < 60_000:
            size += len(texts[last])
            last += 1
        joined = "\0".join(t.replace("\0", " ") for t in texts[at:last]).lower()
        points = np.frombuffer(f"\0{joined}\0".encode("utf-32-le"), np.uint32)
        mark = points == 0
        letter = _letters()[points]
        keep = letter | mark
        keep[1:] |= letter[:-1]
        kind = np.where(letter, points, 32).astype(np.uint32)
        kind[mark] = 0
        kind, mark = kind[keep], mark[keep]
        # Marks lie between texts: the text of a place is the number of marks before it.
        text = np.cumsum(mark) - 1
        gram = np.zeros(max(0, len(kind) - NGRAM + 1), np.uint64)
        whole = np.ones(len(gram), bool)
        for k in range(NGRAM):
            part = kind[k : k + len(gram)]
            gram = common.mix(gram * np.uint64(31) + part + np.uint64(1))
            if 0 < k < NGRAM - 1:
                whole &= part != 0
        # A text's first and last n-grams hold the marks around it, which act as spaces.
        key = (text[: len(gram)][whole].astype(np.uint64) << np.uint64(15)) | (gram[whole] & np.uint64(BUCKETS - 1))
        key, count = np.unique(key.astype(np.uint32), return_counts=True)
        yield (key >> np.uint32(15)).astype(np.int64) + at, (key & np.uint32(BUCKETS - 1)).astype(np.int64), count
        at = last


@dataclass
class Model:
    """Log probabilities of n-grams, one column per language, and the languages' names."""

    languages: list[str]
    table: np.ndarray


def train(docs: DataFrame, *, pseudo: float = PSEUDO) -> Model:
    """Count n-grams of all rows with ``text`` and ``lang``; rows with a null in either are left out.

    Tasks add up what they read and emit one row per language and n-gram, so a language that
    most documents have is no hot group. The model has a fixed number of n-grams; its number
    of languages is checked before anything is collected.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    names = [r[0] for r in rows.groupBy("lang").count().limit(MODEL_LANGUAGES + 1).select("lang").collect()]
    if len(names) > MODEL_LANGUAGES:
        raise ValueError(f"more than {MODEL_LANGUAGES} languages")
    names.sort()
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").to_pylist()
            for text, gram, n in ngram_counts(texts):
                of = langs[text]
                for lang in set(of.tolist()):
                    mine = of == lang
                    table = sums.setdefault(lang, np.zeros(BUCKETS))
                    table += np.bincount(gram[mine], weights=n[mine], minlength=BUCKETS)
        for lang, table in sums.items():
            gram = np.flatnonzero(table)
            yield common.batch_of(
                {"lang": [lang] * len(gram), "gram": gram.astype(np.int32), "n": table[gram].astype(np.int64)}, schema
            )

    counted = rows.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(names)), pseudo)
    place = {name: i for i, name in enumerate(names)}
    found = counted.toArrow()
    np.add.at(
        table,
        (found.column("gram").to_numpy(), np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)),
        found.column("n").to_numpy(),
    )
    return Model(names, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def _climb(
    like: np.ndarray, count: np.ndarray, sizes: np.ndarray, theta: np.ndarray, steps: int, slack: float
) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest proportions of each text, and their log likelihoods.

    Expectation-maximisation, every third step of which is extrapolated from the two before. The
    likelihood is concave: its largest slope tells how far below its top it can still be. A text is done
    when that is at most ``slack``.
    """
    out = theta.copy()
    here, older, middle = np.arange(len(theta)), theta, theta
    rows, left, n, now = like, count, sizes, theta
    for step in range(steps):
        total = np.add.reduceat(left, np.cumsum(n) - n)
        whole = (rows * np.repeat(now, n, axis=0)).sum(axis=1)
        slope = np.add.reduceat(rows * (left / whole)[:, None], np.cumsum(n) - n, axis=0)
        out[here] = now
        go = slope.max(axis=1) - total > slack
        if not go.any():
            break
        following = now * slope / total[:, None]
        if step % 3 == 0:
            older, middle = now, following
        elif step % 3 == 1:
            first, bend = middle - older, following - 2 * middle + older
            size = np.sqrt(np.square(first).sum(axis=1) / np.maximum(np.square(bend).sum(axis=1), 1e-300))
            size = np.clip(size, 1, 64)[:, None]
            following = np.maximum(older + 2 * size * first + size * size * bend, 1e-9)
            following /= following.sum(axis=1, keepdims=True)
        now = following
        if go.mean() < 0.7:
            keep = np.repeat(go, n)
            rows, left = rows[keep], left[keep]
            here, n, now, older, middle = here[go], n[go], now[go], older[go], middle[go]
    value = np.add.reduceat(count * np.log((like * np.repeat(out, sizes, axis=0)).sum(axis=1)), np.cumsum(sizes) - sizes)
    return out, value


def mixtures(model: Model, texts: list[str], *, most: int | None = None, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """One row of language proportions per text, zero outside its chosen set, and the text's fit; zeros without n-grams.

    A set begins with the likeliest single language and takes in the one in whose direction the likelihood rises most, as long as
    the penalised likelihood rises: at most ``most`` languages, or all. The fit is the mean log likelihood
    of an n-gram above that of n-grams drawn evenly: at zero or below, no mixture explains the text better than chance.
    """
    out, fits = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    width = len(model.languages)
    if not width:
        return out, fits
    for text, gram, count in ngram_counts(texts):
        if not len(text):
            continue
        first = np.flatnonzero(np.diff(text, prepend=-1))
        owner, sizes = text[first], np.diff(np.append(first, len(text)))
        count = count.astype(np.float64)
        total = np.add.reduceat(count, first)
        logs = model.table[gram].astype(np.float64)
        # Each n-gram is scaled by its largest likelihood, which moves all sets alike.
        top = logs.max(axis=1)
        like = np.exp(logs - top[:, None]) + 1e-12
        alone = np.add.reduceat(count[:, None] * np.log(like), first, axis=0)
        picked = alone.argmax(axis=1)[:, None]
        share, value = np.zeros_like(alone), alone.max(axis=1)
        np.put_along_axis(share, picked, 1.0, axis=1)
        # What one more language costs.
        cost = 0.5 * np.log(total) + np.log(width)
        alive = np.arange(len(first))
        while len(alive) and picked.shape[1] < (most or width):
            mine = np.repeat(np.isin(np.arange(len(first)), alive), sizes)
            rows, left, n = like[mine], count[mine], sizes[alive]
            whole = (rows * np.repeat(share[alive], n, axis=0)).sum(axis=1)
            slope = np.add.reduceat(rows * (left / whole)[:, None], np.cumsum(n) - n, axis=0)
            np.put_along_axis(slope, picked, -np.inf, axis=1)
            # The slopes bound what any larger set can gain.
            more = slope.max(axis=1) - total[alive] > cost[alive]
            added = slope.argmax(axis=1)[more]
            keep = np.repeat(more, n)
            alive, rows, left, n = alive[more], rows[keep], left[keep], n[more]
            if not len(alive):
                break
            picked = np.column_stack([picked[more], added])
            start = np.full(picked.shape, 0.1 / (picked.shape[1] - 1))
            start[:, 0] = 0.9
            if picked.shape[1] > 2:
                start = np.column_stack([0.9 * np.take_along_axis(share[alive], picked[:, :-1], axis=1), np.full(len(alive), 0.1)])
            some = np.take_along_axis(rows, np.repeat(picked, n, axis=0), axis=1)
            found, reached = _climb(some, left, n, start, steps, SLACK)
            better = reached - value[alive] > cost[alive]
            alive, picked = alive[better], picked[better]
            value[alive] = reached[better]
            share[alive] = 0
            full = np.zeros((len(alive), width))
            np.put_along_axis(full, picked, found[better], axis=1)
            share[alive] = full
        out[owner] = share
        fits[owner] = (value + np.add.reduceat(count * top, first)) / total + np.log(BUCKETS)
    return out, fits


def proportions(model: Model, texts: list[str], *, most: int | None = None, steps: int = STEPS) -> np.ndarray:
    return mixtures(model, texts, most=most, steps=steps)[0]


def identify(docs: DataFrame, model: Model, *, most: int | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``mixture`` and ``fit``, from nothing but ``text``.

    ``mixture`` maps each language of the chosen set to its proportion; ``lang_pred`` is the
    one with the largest (the first by name among equals), ``score`` that proportion, ``fit`` how much likelier an n-gram is
    than by chance, as a logarithm. A text that is null or
    has no letter is ``und`` with score and fit 0 and an empty mixture, as is any text under a model
    without languages. A column of ``docs`` that has one of the four names gives way. The
    model (32,768 numbers per language) is broadcast.
    """
    found, names = common.spare(docs, "found"), ("lang_pred", "score", "mixture", "fit")
    return docs.withColumn(found, _identified(docs, model, most)).select(
        *common.others(docs, *names), *[f"{found}.{name}" for name in names]
    )


def keep(docs: DataFrame, model: Model, *, least: float = 0.0, most: int | None = None) -> DataFrame:
    """The rows whose text some mixture of languages explains better than chance, with the columns they have.

    Texts in several languages stay, whatever their proportions. Rows without letters go, and those whose
    fit is ``least`` or lower.
    """
    found = common.spare(docs, "found")
    sure = (F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.fit") > least)
    return docs.withColumn(found, _identified(docs, model, most)).where(sure).drop(found)


def _identified(docs: DataFrame, model: Model, most: int | None):
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, table = shared.value
        here = Model(languages, table)
        for column in texts:
            values = [t if t is not None else "" for t in column.to_pylist()]
            share, fit = mixtures(here, values, most=most)
            # Letters that this Python does not know tell nothing of the language.
            lost = (share.sum(axis=1) == 0) & np.array([bool(v) for v in values], bool)
            share[lost] = 1.0 / max(1, len(languages))
            best = share.argmax(axis=1) if languages else np.zeros(len(values), int)
            score = share.max(axis=1) if languages else np.zeros(len(values))
            names = [languages[b] if s > 0 else UNKNOWN for b, s in zip(best.tolist(), score.tolist())]
            mixture = [
                [(languages[k], float(row[k])) for k in np.flatnonzero(row)] for row in share
            ]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(np.minimum(score, 1.0), pa.float64()),
                    pa.array(mixture, pa.map_(pa.string(), pa.float64())),
                    pa.array(fit, pa.float64()),
                ],
                names=["lang_pred", "score", "mixture", "fit"],
            )

    predicted = F.arrow_udf(predict, "lang_pred string, score double, mixture map<string,double>, fit double")
    there = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return predicted(F.when(there, F.col("text")))
