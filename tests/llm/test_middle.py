from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from skyledger.llm import middle

from .conftest import collected, documents

COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def plain(doc_id, text, unit="tokens"):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "tokens" else list(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, body, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(head), len(body), f"<S>{tail}<P>{head}<M>{body}")
    return (doc_id, n, "psm", len(head), len(body), f"<P>{head}<S>{tail}<M>{body}")


def texts():
    rng = random.Random(7)
    letters = "aZ b\n<PSM>é☃\U0001f600ß\t.1\0"
    made = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(400)]
    return [*made, "<P>", "x<S>y", "<M", "<", "<<P>", "<S<S", "\U0001f600" * 999, "a" * 9999, "é", "aé", "éa"]


def check(spark, rows, unit):
    df = documents(spark, rows).withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit(0.5)})
    got = middle.fill_in_middle(df, unit=unit)
    assert sorted(collected(got, *COLUMNS), key=repr) == sorted((plain(*r[:2], unit) for r in rows), key=repr)
    assert set(df.columns) <= set(got.columns)
    back = got.select(F.coalesce("text", F.lit("")) == middle.restored(F.col("output"), F.col("form")))
    assert {r[0] for r in back.collect()} == {True}


def test_outputs_and_texts_made_of_them(spark):
    rows = [(k, t, "en", "a") for k, t in enumerate(texts())]
    check(spark, rows, "tokens")
    check(spark, rows, "points")


def test_awkward(spark, awkward):
    rows = collected(awkward, "doc_id", "text")
    got = middle.fill_in_middle(awkward)
    assert sorted(collected(got, *COLUMNS), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert got.count() == awkward.count()


def test_no_documents(spark, nothing):
    assert middle.fill_in_middle(nothing).count() == 0


def test_forms_come_at_their_rates(spark):
    rows = [(k, "some words of a text", "en", "a") for k in range(4000)]
    forms = {r["form"]: r["count"] for r in middle.fill_in_middle(documents(spark, rows)).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 400) < 80 and abs(forms["spm"] - 720) < 100


def test_index_of_multibyte_characters():
    text = "aé☃\U0001f600z\U0010ffffß" * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    index = middle.SparseIndex(raw)
    ends = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert (index.to_points(ends) == np.arange(len(text) + 1)).all()
    assert (index.to_bytes(np.arange(len(text) + 1)) == ends).all()
    assert len(index.bytes) == sum(ord(c) > 127 for c in text)
    assert len(middle.SparseIndex(np.frombuffer(b"plain", np.uint8)).bytes) == 0
