"""The registered queries of this package, each over its whole table, and their SQL answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(common.prepared(spark), sf_dir)

        QUERIES[name] = prepared
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h""",
)
def op1_warc(spark, sf_dir):
    from skyledger.llm import warc

    folder = common.shared_dir(spark, "warc")
    manifest = warc.write_archives(common.table(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(manifest, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_token_ids")
def op5_token_ids(spark, sf_dir):
    from skyledger.llm import tokens

    folder = common.shared_dir(spark, "ids")
    manifest = tokens.write_ids(
        common.table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end=2, drops_space=True
    )
    return tokens.read_ids(manifest, folder)


@query("op4_packing")
def op4_packing(spark, sf_dir):
    from skyledger.llm import packing

    return packing.packed_documents(
        common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2, drops_space=False
    )


@query("op9_mixing")
def op9_mixing(spark, sf_dir):
    from skyledger.llm import mixing

    docs = common.table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.withColumn("row", F.col("doc_id")), "row")
    return mixed.select(
        F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op10_prefix_fingerprints")
def op10_prefix_fingerprints(spark, sf_dir):
    from skyledger.llm import prefixhash

    return prefixhash.fingerprints(common.table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    """The measures, the tested cutoffs and the verdicts, from the operator's own parameters."""
    from skyledger.llm.rules import CUTOFFS, LEVEL, MIN_WORDS, RISK

    grid = ", ".join(f"('{rule}', {float(c)}::DOUBLE)" for rule, values in CUTOFFS.items() for c in values)
    columns = {
        "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"),
        "long_words": ("word_chars", "n_words"),
    }
    shares = ", ".join(f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END AS {rule}" for rule, (a, b) in columns.items())
    values = " ".join(f"WHEN '{rule}' THEN {rule}" for rule in columns)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce('s' || lang, 'n') AS stratum, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM t),
g AS (SELECT id, i, count(*) OVER (PARTITION BY id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n
  FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
c AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT id, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (SELECT doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(x) - length(regexp_replace(x, '\p{{Lu}}+', '', 'g')) AS n_upper
  FROM w JOIN l USING (id) LEFT JOIN c USING (id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {shares} FROM m),
v AS (SELECT doc_id, stratum, base_failed, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule, cutoff,
    CASE rule {values} END > cutoff AS above FROM r, (VALUES {grid}) AS grid(rule, cutoff)),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
k AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (above) AS k FROM v JOIN good USING (doc_id)
  WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, (SELECT count(DISTINCT stratum) FROM k) * (SELECT count(*) FROM (VALUES {grid})) AS tests,
    list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) AS tail
  FROM k WHERE k <= n * {RISK}),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM p WHERE tail <= {LEVEL}::DOUBLE / tests GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.stratum = r.stratum AND CASE rule {values} END > cutoff) AS kept
FROM r"""


@query("op3_quality_rules", _quality_sql())
def op3_quality_rules(spark, sf_dir):
    from skyledger.llm import rules

    judged = rules.judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op2_language_mixture")
def op2_language_mixture(spark, sf_dir):
    from skyledger.llm import langid

    docs = common.table(spark, sf_dir, "documents")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4) == 2
    # A null doc_id has no remainder, so its row is not held out.
    rows = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = langid.train(rows.where("NOT held_out").select("text", "lang"))
    found = langid.identify(rows.select("doc_id", "held_out", "text"), model).drop("text")
    return found.withColumn("mixture", F.to_json("mixture"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    from skyledger.llm import quality

    docs = common.table(spark, sf_dir, "documents")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.judged(docs.select("doc_id", "text"), model).drop("text")


@query("op7_subword_lattice")
def op7_subword_lattice(spark, sf_dir):
    from skyledger.llm import lattice

    docs = common.table(spark, sf_dir, "documents")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 7) == 2
    rows = docs.select("doc_id", "text", (~F.coalesce(held_out, F.lit(False))).alias("train"))
    return lattice.scored(rows, vocabulary("piece_bpe_32k.model"))


@query(
    "op8_chosen_path",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
    THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]
    ELSE [array_to_string(words, ' ')] END) AS x
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
j AS (
  SELECT c.a, c.b, c.c = p.n AND c.c = q.n AS same FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b
  WHERE 5 * c.c >= 4 * (p.n + q.n - c.c)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, j.b FROM r JOIN j ON r.b = j.a),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links, min(CASE WHEN same THEN b END) AS other FROM j GROUP BY a)
SELECT w.doc_id, k.class_id, least(w.doc_id, coalesce(l.other, w.doc_id)) AS copy_id, coalesce(l.n_links, 0) AS n_links
FROM w JOIN k ON k.a = w.doc_id LEFT JOIN l ON l.a = w.doc_id""",
)
def op8_chosen_path(spark, sf_dir):
    from skyledger.llm import chosenpath

    return chosenpath.near_classes(common.table(spark, sf_dir, "documents")).drop("class_key", "text_key")


def _clusters_sql() -> str:
    """All rounds of the clustering, from the operator's own parameters."""
    from skyledger.llm.zonemaps import CLUSTERS, DIMENSIONS, ROUNDS, SCALE

    parts = [f"""
WITH e AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS i, v AS c FROM e QUALIFY i < {CLUSTERS})"""]
    for k in range(ROUNDS + 1):
        parts.append(f"""
d{k} AS (SELECT id, vec_id, v, i, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
  FROM e, c{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, i) = 1)""")
        if k < ROUNDS:
            parts.append(f"""
s{k} AS (SELECT i, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM d{k}) GROUP BY i, p),
c{k + 1} AS (SELECT c{k}.i, coalesce(m.c, c{k}.c) AS c FROM c{k}
  LEFT JOIN (SELECT i, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM s{k} GROUP BY i) m ON m.i = c{k}.i)""")
    return ",".join(parts) + f"""
SELECT vec_id, i::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY i))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM d{ROUNDS} JOIN c{ROUNDS} USING (i)"""


@query("op11_zone_maps", _clusters_sql())
def op11_zone_maps(spark, sf_dir):
    from skyledger.llm import zonemaps

    return zonemaps.clustered(common.table(spark, sf_dir, "embeddings"))


@query(
    "op12_fill_in_middle",
    """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
)
def op12_fill_in_middle(spark, sf_dir):
    from skyledger.llm import middle

    made = middle.fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op13_window_packing")
def op13_window_packing(spark, sf_dir):
    from skyledger.llm import windows

    pieces = windows.packed_documents(
        common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2, drops_space=True
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
