"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence comes from two logistic classifiers that are fitted on labelled documents (at most SAMPLE of
them, those with the least hash of their id), equal texts as one with their mean labels: one for quality, on shares of
letters, signs and repeated words; one for toxicity, on the weights of a text's forms: its words, and the beginnings of
5 to 10 bytes of longer ones, which inflected forms and compounds share. A form weighs the lower end (two errors) of the log of the
ratio of its rates in toxic and other labelled texts, with a prior of half a text each, less that of a quarter more, or nothing
where this is below zero: a form met once says nothing, one met in a few toxic texts alone says a little, at any number of labels and
any share of toxic ones. A labelled text's own weights are taken without its own label, so that the classifier learns what forms say of
texts that they were not counted in. Evidence of all documents is averaged by site at each level, global, host and path, in
grouped aggregates; at each level a site's rate is shrunk toward the level above with a strength estimated from the
variance between sites, so that sparse sites lean on their prior. A document's posterior adds to its own log-odds what
its site's rate adds to the global one.

Defined cases: a null text is empty; documents without labels are judged like others; without labels of both kinds a
classifier says its prior; where both kinds of toxic labels occur but no form has a weight, the toxic one does, with a
warning; null level columns form a site of their own; repeated rows get equal results; a very long text is read whole by
one task; an empty table gives an empty result; other columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pamspark.llm.common import ALNUM, blocks, mix, shingle_hashes, text_bytes, word_hashes, word_places, written

SAMPLE = 20_000
#: A form's weight is so many errors below its estimate and counts from such a ratio of rates; beginnings of words have so many bytes.
ERRORS, LIFT = 2.0, 1.25
SHORTEST, LONGEST = 5, 10
KEEP = 0.5
#: Odd factor of the hashes of beginnings.
BEGIN = np.uint64(0xD1B54A32D192ED03)
RESULTS = ("p_own", "p_toxic", "p_site", "p_keep", "keep")
_SETS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?\"'()-", b"!", b"|", b"#$%&*@^~_=+<>{}[]\\/`", b" \t\r\f\x0b", b"\n"]


def _signed_share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each text, its word hashes and their offsets."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    out = [np.log1p(size)]
    for chars in _SETS:
        lut = np.zeros(256, np.uint8)
        lut[np.frombuffer(chars, np.uint8)] = 1
        sums = np.concatenate(([0], np.cumsum(lut[data], dtype=np.int64)))
        out.append(_signed_share(np.diff(sums[offsets]), size))
    words, at = word_hashes(data, offsets, ALNUM)
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n)
    out += [np.log1p(n), _signed_share(size, n) / 10]
    for lag in (1, 2):
        same = np.zeros(len(words), bool)
        same[lag:] = (words[lag:] == words[:-lag]) & (rows[lag:] == rows[:-lag])
        out.append(_signed_share(np.bincount(rows[same], minlength=len(n)), n))
    # places of words and of word runs that stood before in the text
    for h, r in ((words, rows), shingle_hashes(words, at)):
        order = np.lexsort((h, r))
        again = np.zeros(len(h), bool)
        again[1:] = (h[order][1:] == h[order][:-1]) & (r[order][1:] == r[order][:-1])
        out.append(_signed_share(np.bincount(r[order][again], minlength=len(n)), np.bincount(r, minlength=len(n))))
    return np.stack(out, axis=1).astype(float), words, at


def forms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of the beginnings of longer ones, the row of each, and the number of words of each text."""
    words, at, (first, last) = word_places(data, offsets, ALNUM)
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n)
    found, owners = [words], [rows]
    size, h = last - first + 1, np.zeros(len(words), np.uint64)
    powers = np.multiply.accumulate(np.full(LONGEST, BEGIN, np.uint64))
    for k in range(LONGEST):
        more = size > k + 1
        first, size, h, rows = first[more], size[more], h[more], rows[more]
        h = h + ALNUM[data[first + k]] * powers[k]
        if k + 1 >= SHORTEST:
            found.append(mix(h ^ BEGIN))
            owners.append(rows)
    return np.concatenate(found), np.concatenate(owners), n


def distinct_forms(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each form of each text once."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], hashes[new]


def form_weight(bad, n, all_bad, total, m=np):
    """Lower end of the log ratio of a form's rates in toxic and other texts, over LIFT; m: numpy, or functions for columns."""
    good, among_bad, among_good = total - all_bad, bad + 0.5, n - bad + 0.5
    error = m.sqrt(1 / among_bad - 1 / (all_bad + 1) + 1 / among_good - 1 / (good + 1))
    return m.log(among_bad / (all_bad + 1)) - m.log(among_good / (good + 1)) - ERRORS * error - float(np.log(LIFT))


def toxic_numbers(rows: np.ndarray, weights: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each text the greatest weight of its forms, the sum of the four greatest, and all of them by the root of its words."""
    order = np.lexsort((-weights, rows))
    rows, weights = rows[order], np.maximum(weights[order], 0)
    at = np.searchsorted(rows, np.arange(len(words)))
    place = np.arange(len(rows)) - at[rows]
    sums = [np.bincount(rows[place < most], weights[place < most], len(words)) for most in (1, 4)]
    return np.stack((*sums, np.bincount(rows, weights, len(words)) / np.sqrt(words + 1)), axis=1)


def toxic_features(column: pa.Array, lexicon: np.ndarray, weigh) -> np.ndarray:
    """`toxic_numbers` of texts; weigh(places in the lexicon, rows) gives the weights of the forms found there."""
    hashes, rows, words = forms(*text_bytes(column))
    if not len(lexicon):
        return np.zeros((len(words), 3))
    found = lexicon[np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)] == hashes
    rows, hashes = distinct_forms(rows[found], hashes[found])
    return toxic_numbers(rows, weigh(np.searchsorted(lexicon, hashes), rows), words)


class Logistic:
    """Ridge logistic regression by Newton steps, on standardised numbers and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.center, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z, self.beta = self._design(x), np.zeros(2 * x.shape[1] + 1)
        if 0 < y.sum() < len(y):
            penalty = np.diag([0.0] + [ridge] * (z.shape[1] - 1))
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-6 * np.eye(z.shape[1]), z.T @ (y - p) - penalty @ self.beta)
                self.beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        else:
            rate = (y.sum() + 1) / (len(y) + 2)
            self.beta[0] = np.log(rate / (1 - rate))

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.concatenate((np.ones((len(x), 1)), z, z * z / 4), axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.beta, -12, 12)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Logistic, Logistic, np.ndarray, np.ndarray]:
    """Quality classifier, toxicity classifier, lexicon and its weights, from at most SAMPLE labelled documents."""
    sample = (labels.select("doc_id", "quality", "toxic").dropna().dropDuplicates(["doc_id"])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    # SAMPLE rows of three numbers
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    marked = marked.groupBy(F.md5(F.coalesce("text", F.lit("")))).agg(
        F.first("text").alias("text"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")).select("text", "quality", "toxic")

    def forms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes, rows, _ = forms(*text_bytes(batch.column("text")))
            rows, hashes = distinct_forms(rows, hashes)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(toxic[rows].astype(float))], ["form", "toxic"])

    marked = written(marked)
    total, bad = marked.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    seen = marked.mapInArrow(forms_of, "form long, toxic double").groupBy("form").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    # forms that have a weight in the view of all texts or of one that is left out, at most those of the sample
    without = F.greatest(F.col("bad"), F.col("n") - 1)
    known = (seen.filter((F.col("bad") > 0) & (form_weight(F.col("bad"), without, float(bad), float(total), F) > 0)).toArrow()
             if min(bad, total - bad) > 0 else seen.limit(0).toArrow())
    lexicon = known.column("form").to_numpy().view(np.uint64)
    order = np.argsort(lexicon)
    lexicon, form_bad, form_n = lexicon[order], known.column("bad").to_numpy()[order], known.column("n").to_numpy()[order]
    weights = form_weight(form_bad, form_n, bad, total)
    if not (weights > 0).any() and min(bad, total - bad) > 0:
        warnings.warn(f"no word tells the {bad:g} toxic of {total} labelled texts from the others", stacklevel=2)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(float)

            def left_out(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
                own = toxic[rows]
                return form_weight(np.maximum(form_bad[at] - own, 0), form_n[at] - 1, np.maximum(bad - own, 0), total - 1)

            x = np.concatenate((features(batch.column("text"))[0], toxic_features(batch.column("text"), lexicon, left_out)), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("quality"),
                                              batch.column("toxic")], ["x", "quality", "toxic"])

    found = marked.mapInArrow(numbers, "x array<double>, quality double, toxic double").toArrow()
    width = len(_SETS) + 10
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, width)
    kept = weights > 0
    return (Logistic(x[:, :-3], found.column("quality").to_numpy().astype(float)),
            Logistic(x[:, -3:], found.column("toxic").to_numpy().astype(float)), lexicon[kept], weights[kept])


def evidence(docs: DataFrame, model: tuple[Logistic, Logistic, np.ndarray, np.ndarray], keep_text: bool = True) -> DataFrame:
    """docs with p_own, the probability that a document is good and not toxic by itself, and p_toxic."""
    good, toxic, lexicon, weights = model
    docs = docs.drop(*RESULTS)
    left = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in left]
        for batch in blocks(batches):
            text = batch.column("text")
            p = toxic(toxic_features(text, lexicon, lambda at, rows: weights[at]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(good(features(text)[0]) * (1 - p)), pa.array(p)],
                                             [*names, "p_own", "p_toxic"])

    return docs.mapInArrow(run, T.StructType([*left, T.StructField("p_own", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_rates(judged: DataFrame, levels: Sequence[str]) -> tuple[DataFrame, float]:
    """(_site, p_site) of the deepest sites, and the global rate; judged has p_own and the level columns."""
    keys = [f"_level{i}" for i in range(len(levels))]
    named = judged.select(*[F.coalesce(F.concat(F.lit("a"), F.col(c).cast("string")), F.lit("n")).alias(k) for c, k in zip(levels, keys)], "p_own")
    sums = written(named.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("p_own").alias("s"), F.sum(F.col("p_own") * F.col("p_own")).alias("q")))
    n, s = sums.agg(F.sum("n"), F.sum("s")).first()
    overall = (s or 0.0) / n if n else 0.5
    above = None
    for depth in range(1, len(keys) + 1):
        by = keys[:depth]
        sites = sums.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        sites = sites.withColumn("prior", F.lit(overall)) if above is None else sites.join(above, by[:-1])
        # moments: variance of site means around their priors, less what chance within sites explains
        mean, size = F.col("s") / F.col("n"), F.col("n")
        within = F.greatest(F.col("q") / size - mean * mean, F.lit(0.0)) / size
        spread, level = sites.agg(F.sum(size * (F.pow(mean - F.col("prior"), 2) - within)) / F.sum(size), F.sum(size * mean) / F.sum(size)).first()
        level = min(max(level if level is not None else 0.5, 1e-6), 1 - 1e-6)
        strength = min(1e6, max(1.0, level * (1 - level) / max(spread or 0.0, 1e-9) - 1))
        rate = (F.col("s") + strength * F.col("prior")) / (size + strength)
        above = sites.select(*by, rate.alias("prior"))
    return written(above.select(F.concat_ws("\x1f", *keys).alias("_site"), F.col("prior").alias("p_site"))), overall


def judge(docs: DataFrame, model: tuple[Logistic, Logistic, np.ndarray, np.ndarray], levels: Sequence[str] = ("source", "lang"),
          keep_at: float = KEEP, keep_text: bool = True) -> DataFrame:
    """docs, without the text unless keep_text, with p_own, p_toxic, p_site, p_keep and keep; texts are read once."""
    judged = written(evidence(docs, model, keep_text))
    sites, overall = site_rates(judged, levels)
    site = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("a"), F.col(c).cast("string")), F.lit("n")) for c in levels])
    joined = judged.withColumn("_site", site).join(sites, "_site").drop("_site")
    total = _logit(F.col("p_own")) + _logit(F.col("p_site")) - _logit(F.lit(overall))
    return joined.withColumn("p_keep", 1 / (1 + F.exp(-total))).withColumn("keep", F.col("p_keep") >= keep_at)
