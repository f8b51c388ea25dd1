from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

from skyledger.llm import chosenpath, common

from .conftest import collected, documents, prose


def shingles(text, width=5):
    words = re.findall(common.WORD, text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows):
    """All pairs: class, copies and number of links of each row."""
    sets = [shingles(t) for _, t in rows]
    near = defaultdict(list)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                near[i].append(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        least = lambda some: min((rows[k][0] for k in some if rows[k][0] is not None), default=None)
        copies = [k for k in seen if sets[k] == sets[i]]
        out.append((doc_id, least(seen), least(copies), len(near[i])))
    return sorted(out, key=repr)


def edited(text, seed, edits):
    words, rng = text.split(), random.Random(f"{seed}")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
    return " ".join(words)


def corpus():
    passage = prose(999, 60)
    texts = [prose(k, 40 + k % 150) for k in range(150)]
    texts += [prose(500 + k, 30 + 3 * k) + "\n" + passage for k in range(60)]
    for k in range(25):
        base = prose(1000 + k, 150)
        texts += [edited(base, (k, j), j) for j in range(k % 6 + 1)] + [base] * (k % 3)
    # A chain: each is near the next, the ends are not near each other.
    words = prose(2000, 200).split()
    texts += [" ".join(words[8 * k : 8 * k + 110]) for k in range(10)]
    texts += ["one", "one", "two words", "", None, " \n", "a b c d", "a b c d e", "x " * 50, "x " * 60]
    order = random.Random(5)
    rows = list(enumerate(texts))
    order.shuffle(rows)
    return [*rows, rows[0], (None, texts[1]), (None, "nowhere else"), (None, None)]


def classes(df, **options):
    return sorted(collected(chosenpath.near_classes(df, **options), "doc_id", "class_id", "copy_id", "n_links"), key=repr)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_all_links_are_found(spark, rows):
    assert classes(documents(spark, rows)) == brute(rows)


def test_order_and_partitions_change_nothing(spark, rows):
    assert classes(documents(spark, rows[::-1]).repartition(7)) == brute(rows)


def test_tiles_and_shallow_paths_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(chosenpath, "TILE_SETS", 3)
    assert classes(documents(spark, rows), depth=1) == brute(rows)


def test_a_crowd_of_near_copies(spark):
    base = prose(7, 120)
    rows = [(k, edited(base, k, k % 4)) for k in range(160)] + [(1000 + k, base) for k in range(300)]
    rows += [(2000 + k, prose(3000 + k, 60) + " " + base[:200]) for k in range(40)]
    assert classes(documents(spark, rows)) == brute(rows)


def test_near_pairs_survive_a_crowded_start(spark, monkeypatch):
    # All sets meet on one start, so that only the extensions can bring the pairs together.
    rows = []
    for k in range(120):
        base = prose(5000 + k, 20 + k)
        rows += [(2 * k, base), (2 * k + 1, edited(base, k, k % 4))]
    one = lambda sets, recall, threshold: sets.selectExpr("set_id", "1L AS weight", "1L AS node")
    monkeypatch.setattr(chosenpath, "_first_paths", one)
    assert classes(documents(spark, rows)) == brute(rows)


def test_near_pairs_of_nothing_but_common_passages(spark):
    passages = [prose(7000 + k, 50) for k in range(12)]
    crowd = ["\n".join(passages[i] for i in some) for some in combinations(range(12), 3)]
    rows = list(enumerate(crowd + [edited(text, k, 2) for k, text in enumerate(crowd[::4])]))
    assert classes(documents(spark, rows)) == brute(rows)


def test_losses_stay_within_the_recall():
    loss = (1 - chosenpath.RECALL) / 3
    assert chosenpath.RECALL >= 0.999999
    for n in (50, 500):
        # Two sides, each extension.
        assert 2 * chosenpath.DEPTH * 0.2 ** chosenpath.tokens_drawn(n) <= loss
        t = 32 - chosenpath.starts_followed(n) + 1
        assert sum(math.comb(32, i) * 0.8**i * 0.2 ** (32 - i) for i in range(t)) <= loss
    assert [chosenpath.tokens_drawn(n) for n in (1, 4, 5, 20)] == [1, 1, 2, 5]


def test_starts_follow_the_recall():
    assert [chosenpath.starts_followed(n) for n in (1, 4, 5, 20)] == [1, 1, 2, 5]
    assert chosenpath.starts_followed(500, recall=0.9) < chosenpath.starts_followed(500) < chosenpath.RUNS


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, k) for k in range(2001, 2050)]
    label = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(collected(chosenpath.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert chosenpath.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_one_of_each(spark, rows, nothing):
    df = documents(spark, rows)
    got = chosenpath.one_of_each(df)
    assert got.columns == df.columns
    named = {c for _, c, _, _ in brute(rows) if c is not None}
    kept = collected(got, "doc_id", "text")
    worded = [r for r in kept if shingles(r[1])]
    assert {r for r in worded if r[0] is not None} == {(d, t) for d, t in rows if d in named and shingles(t)}
    # One class has no doc_id at all; no row is there twice.
    assert [t for d, t in worded if d is None] == ["nowhere else"] and len(set(worded)) == len(worded)
    assert len([r for r in kept if not shingles(r[1])]) == len([r for r in rows if not shingles(r[1])])
    assert chosenpath.one_of_each(nothing).count() == 0


def test_awkward_rows(spark, awkward, nothing):
    assert classes(awkward) == brute(collected(awkward, "doc_id", "text"))
    assert classes(nothing) == []
