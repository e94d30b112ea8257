"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pamspark.llm import (decontaminate, fingerprint as fp, html, importance, licenses, lm, mixing, neardup, packing, quality, sharding,
                          spelling, warc)
from pamspark.llm.common import bounded_batches, shared_folder, written
from pamspark.sources.io import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, which end like the next document begins."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fp.with_next(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                                              F.substring("next_text", F.lit(1), half)))
    rows = fp.fingerprints(fp.fingerprints(rows), "edited", "edited_fingerprint")
    after = F.coalesce(fp.next_in_range("fingerprint", "doc_id", "text"),
                       F.when(F.col("_is_last"), fp.fingerprint(F.col("next_text"))))
    rows = rows.withColumn("next_fingerprint", after)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       fp.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       fp.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    ship_package(spark)
    bounded_batches(spark)
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, as it is or with other numbers, names and units."""
    ship_package(spark)
    bounded_batches(spark)
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("tid")


def op4_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards of a hash ring, counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.place(docs, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior of all documents to be good and not toxic, and whether a corpus keeps them."""
    ship_package(spark)
    bounded_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep_text=False).select("doc_id", "source", "lang", *quality.RESULTS)


def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices of all documents."""
    ship_package(spark)
    bounded_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, keep_text=False)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of all documents; is_first marks the one that a corpus keeps."""
    ship_package(spark)
    bounded_batches(spark)
    found = neardup.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back, equal payloads once."""
    ship_package(spark)
    bounded_batches(spark)
    folder = shared_folder(spark)
    warc.write(_table(spark, sf_dir, "pages"), folder)
    found = warc.resolved(warc.read(spark, folder), F.octet_length("payload").cast("long").alias("payload_bytes"),
                          warc.payload_digest(F.col("payload")).alias("payload_digest"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of all documents under a context tree of bytes, and under unigrams of words."""
    ship_package(spark)
    bounded_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of each document."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    mixed = mixing.mix(written(docs), keys=["doc_id", "crc"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words; a run whose digest 97 divides loses a code point first."""
    ship_package(spark)
    runs = spelling.runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.withColumn("h", F.crc32(key))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.group(spelling.counted(words))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens, a row for each piece."""
    ship_package(spark)
    bounded_batches(spark)
    tokens = packing.tokenized(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(tokens)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight toward the benchmark; a tenth of those with 20 words or more is drawn."""
    ship_package(spark)
    bounded_batches(spark)
    found = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_fingerprints, op2_main_text, op3_benchmark_templates, op4_hash_ring, op5_site_quality, op6_license_notices,
             op7_near_duplicates, op8_revisits, op9_context_tree, op10_mix, op11_permuterm_variants, op12_vector_packing,
             op13_importance_sample)
    return {f.__name__: f for f in found}


#: Base32 of a hexadecimal SHA-1, digit by digit: ten hexadecimal digits are eight of base32.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, {10 * (i // 8) + 1}, 10))::BIGINT >> {35 - 5 * (i % 8)}) & 31 AS INTEGER), 1)"
    for i in range(32))

#: The records are told by the pages alone.
OP8_SQL = f"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM w
"""


#: CRC-32 of the strings of `wanted(s)`, as `crc(s, h)`: what each byte adds at its distance from the end, and the lengths' constants.
CRC_SQL = """
first(b, i, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM first WHERE i < 8),
step AS (SELECT b, v FROM first WHERE i = 8),
longest AS (SELECT max(strlen(s)) AS n FROM wanted),
added(d, b, v) AS (SELECT 0, b, v FROM step UNION ALL
  SELECT d + 1, a.b, xor(s.v, a.v >> 8) FROM added a JOIN step s ON s.b = a.v & 255, longest WHERE d < n),
started(n, v) AS (SELECT 0, 4294967295::BIGINT UNION ALL
  SELECT t.n + 1, xor(s.v, t.v >> 8) FROM started t JOIN step s ON s.b = t.v & 255, longest l WHERE t.n < l.n),
places AS (SELECT s, hex(s) AS hex, strlen(s) AS n, unnest(range(strlen(s))) AS i FROM wanted),
crc AS (SELECT p.s, xor(xor(bit_xor(a.v), any_value(t.v)), 4294967295) AS h
  FROM places p JOIN added a ON a.d = p.n - 1 - p.i AND a.b = ('0x' || substr(p.hex, 2 * p.i + 1, 2))::BIGINT JOIN started t ON t.n = p.n GROUP BY p.s)"""

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Near words by deletions and by patterns with one place left open.
OP11_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, {_LOWERED.format("unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+'))")} AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
wanted AS (SELECT doc || ':' || run AS s FROM counted), {CRC_SQL},
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM counted JOIN crc ON s = doc || ':' || run),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
deleted AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM spots),
opened AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS pattern FROM spots),
near AS (SELECT d.word AS a, w.word AS b FROM deleted d JOIN words w ON w.word = d.less
  UNION ALL SELECT w.word, d.word FROM deleted d JOIN words w ON w.word = d.less
  UNION ALL SELECT x.word, y.word FROM opened x JOIN opened y ON x.pattern = y.pattern AND x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, (array_agg(struct_pack(word := b, n := w.n) ORDER BY w.n DESC, b))[1] AS top FROM near JOIN words w ON w.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 2 * w.n THEN top.word END AS form,
  CASE WHEN top.n >= 2 * w.n THEN top.n END AS form_n FROM words w LEFT JOIN best ON a = w.word),
chain(word, here) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.here AS root FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

OP13_SQL = f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT k, unnest(regexp_extract_all({_LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS s FROM texts),
sought AS (SELECT unnest(regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS s FROM benchmark),
wanted AS (SELECT s FROM found UNION SELECT s FROM sought), {CRC_SQL},
raw AS (SELECT h % 10000 AS bucket, count(*) AS n FROM found JOIN crc USING (s) GROUP BY 1),
target AS (SELECT h % 10000 AS bucket, count(*) AS n FROM sought JOIN crc USING (s) GROUP BY 1),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM raw)::DOUBLE AS a, (SELECT coalesce(sum(n), 0) FROM target)::DOUBLE AS b),
gains AS (SELECT r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (a + 10000) / ((r.n + 1)::DOUBLE * (b + 10000))))::BIGINT AS gain
  FROM raw r LEFT JOIN target t USING (bucket), totals),
weighed AS (SELECT k, count(*) AS n, sum(gain)::BIGINT AS total FROM found JOIN crc USING (s) JOIN gains ON bucket = h % 10000 GROUP BY k),
scored AS (SELECT k, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM texts LEFT JOIN weighed USING (k)),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranked) THEN rank END AS rank
FROM noisy LEFT JOIN ranked USING (k)
"""


def oracles() -> dict[str, str]:
    return {"op8_revisits": OP8_SQL, "op11_permuterm_variants": OP11_SQL, "op13_importance_sample": OP13_SQL}
