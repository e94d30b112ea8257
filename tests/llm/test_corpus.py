"""The corpus operators against brute force, on small tables and on the edge cases that their docstrings define."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pamspark.llm import decontaminate, fingerprint, html, html_pages, licenses, lm, mixing, neardup, quality, queries, sharding, warc
from pamspark.llm.common import ALNUM, SPACED, bounded_batches, salted_join, shared_folder, text_bytes, word_hashes, written_in_buckets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGES = [(1, None, "en", "a", None, 7, "x"), (2, "", None, "a", 0, 7, "x"), (3, LONG, "en", None, len(LONG), None, None),
         (4, "one two three four five six seven", "en", "b", 34, 1, "x"), (4, "one two three four five six seven", "en", "b", 34, 1, "x"),
         (None, "one two three four five six seven", None, "b", 34, 1, "x"), (6, " \n ", "en", "b", 3, 1, "x"),
         (7, "Licensed under the Apache License, Version 2.0", "en", "b", 46, 1, "x"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, edges, tmp_path_factory):
    """A table folder whose documents, labels, benchmark and pages are the edge cases; and one with empty tables."""
    full, empty = tmp_path_factory.mktemp("edges"), tmp_path_factory.mktemp("empty")
    pages = spark.createDataFrame([(1, "http://a/b", None, 1), (2, None, "", 2), (None, "http://a/c", "<p>x</p>", 3), (4, "u\r\nv", "<p>x</p>", 4),
                                   (4, "u\r\nv", "<p>x</p>", 4), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n", 5), (6, "u", "<p>é&amp;", 6)],
                                  "page_id long, url string, html string, text int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Alice Smith bought 3 kg of red apples from the old farm near town")], "item_id long, text string")
    for name, table in (("documents", edges), ("pages", pages), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{full}/{name}.parquet")
        table.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)


@pytest.mark.parametrize("name", list(queries.registered()))
def test_edge_cases_and_empty_tables(spark, folder, name):
    full, empty = folder
    rows = queries.registered()[name](spark, full).collect()
    of_each_row = name not in ("op3_benchmark_templates", "op11_permuterm_variants", "op12_vector_packing")
    assert not of_each_row or len(rows) == (7 if name in ("op2_main_text", "op8_revisits") else len(EDGES))
    assert queries.registered()[name](spark, empty).collect() == []


def test_pipeline_edges(spark, folder):
    full, empty = folder
    assert corpus_pipeline.run(spark, empty).count() == 0
    out = corpus_pipeline.run(spark, full)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out.columns)


def tuples(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF).collect()}
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    errors = []
    for i, (key, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert rows[key].n_chars == len(text) and rows[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, rows[key].near_edited), (after, rows[key].near_next)):
            a, b = tuples(text), tuples(other)
            errors.append(near - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    same = collections.defaultdict(set)
    for key, text in texts:
        same[text].add(rows[key].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprint_by_hand(spark):
    """One bin by bin: least hash per bin, optimal densification, low bits."""
    text = "the quick brown fox jumps over the lazy dog again and again"
    h = lambda v, seed=42: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(
        v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if abs(v) >> 31 or isinstance(v, Long) else v.to_bytes(4, "little", signed=True), seed % (1 << 64)))
    class Long(int):
        pass
    def chain(values):
        seed = 42
        for v in values:
            seed = h(v, seed)
        return seed
    words = [h(w) for w in text.split()]
    bins = {}
    for i in range(len(words) - 4):
        s = chain([Long(w) for w in words[i:i + 5]]) & ((1 << 63) - 1)
        bins.setdefault(s >> 56, []).append(s & ((1 << 56) - 1))
    dense = []
    for i in range(128):
        if i in bins:
            dense.append(min(bins[i]))
            continue
        tried = [chain([i, r]) % 128 for r in range(fingerprint.PROBES)]
        hit = [t for t in tried if t in bins]
        dense.append(min(bins[hit[0]]) if hit else min(bins[min(bins, key=lambda j: chain([i, fingerprint.PROBES, j]))]))
    want = "".join(f"{chain([Long(v), i]) & 255:02x}" for i, v in enumerate(dense))
    got = spark.range(1).select(fingerprint.fingerprint(F.lit(text)).alias("f")).first().f
    assert got == want


def test_html_held_out_layouts():
    trees, source, right, total = html.trained(), html_pages.Pages(4321), 0, 0
    for _ in range(150):
        page, main = source.page()
        got = html.main_text(page, trees).split("\n\n")
        want = [" ".join(b.split()) for b in main]
        right += got == want
        total += 1
    assert right / total > 0.88


@pytest.mark.parametrize("before", [
    '<svg-icon name="x"></svg-icon>', "<button-group><b></b></button-group>", "<select-menu></select-menu>", "<object-list></object-list>",
    '<datalist><option value="a"><option value="b">b</datalist>', "<div><button>Menu</div>", "<span><button>Menu</span>", "<button>Menu",
    "<noscript><img src=x>", "<iframe src=x>", "<select><option>a<option>b", "<title>Name", "<svg><path d=''/>", '<svg aria-label="a>b"><p>x</p></svg>',
    "<select><option>a<option>b</select>", "<button><div>Menu</div><p>x</p></button>", "<svg/>", "<template><p>x</p><svg></svg></template>",
    "<script>var a = '<script>';</script>", "<script data-a=it's>var a;</script>", "<ul><li><button>a<li><button>b</ul>"])
def test_html_reads_past_dropped_elements(before):
    for after in ("", "<p><svg><title>x</title></svg></p><button>x</button><iframe></iframe><noscript>x</noscript><select><option>x</select>"):
        nodes, pieces = html.parse(f"{before}<p>Article text</p>{after}")
        assert [words for _, words in pieces] == ["Article text"]
        assert sum(n.own for n in nodes) == 12 and all(c in nodes for n in nodes for c in n.children)


def test_html_drops_inside_a_block():
    page = "<p>One <button>Copy<div>all</div></button>two <a>three <svg><g>x</g></svg></a><math><mi>x</mi><annotation>y</annotation></math> four</p><p>five</p>"
    nodes, pieces = html.parse(page)
    assert [words for _, words in pieces] == ["One two three x four", "five"] and [n.tag for n in nodes] == ["root", "p", "p"]


def test_html_pages_table(spark):
    import html as entities
    rows = {r.page_id: r for r in queries.op2_main_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want)


def test_decoding_is_consistent():
    nodes, _ = html.parse("<div><div><p>a</p><p>b</p></div><p>c</p></div>")
    html.node_features(nodes)
    rng = np.random.default_rng(1)
    for _ in range(200):
        kept = html.decode(nodes, rng.uniform(0.01, 0.99, len(nodes)))
        number = {id(n): i for i, n in enumerate(nodes)}
        for n in nodes:
            if n.parent and kept[number[id(n.parent)]]:
                assert kept[number[id(n)]]


def test_templates(spark):
    bounded_batches(spark)
    items = spark.createDataFrame([(1, "Last week John Miller sold 12 kg of ripe plums to the corner shop for 40 dollars and then walked home")], "item_id int, text string")
    base = "Some words before. Last week {0} sold {1} kg of ripe plums to the corner shop for {2} dollars and then walked home. More words after."
    docs = spark.createDataFrame([(1, base.format("John Miller", 12, 40)), (2, base.format("Anna", "seventeen", 99)), (3, "ripe plums to the corner shop " * 9),
                                  (4, "Nothing of that kind stands here at all, only other words in some other order, again and again.")], "doc_id long, text string")
    found = {r.doc_id: r.kind for r in decontaminate.leaks(docs, items).collect()}
    assert found == {1: "exact", 2: "reparameterised"}


def leaked(spark, items, texts):
    bounded_batches(spark)
    items = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    found = decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), items).collect()
    return {(r.doc_id, r.item_id): r.kind for r in found}


def test_templates_do_not_depend_on_what_stands_before(spark):
    item = "Mary has {} red apples and gives away {} of them"
    renamed = item.replace("Mary", "Tom").format(7, 3)
    heads = ["", "Exercise one\n", "Question Bank\n", "Exercise one. ", "so "]
    found = leaked(spark, [item.format(5, 2), "Day by day the 3 old farmers sell fresh milk to us"],
                   [h + item.format(5, 2) for h in heads] + [h + renamed for h in heads] + ["Exercise 1\nDay by day the 4 old farmers sell fresh milk to us"])
    assert set(found) == {(i, 0) for i in range(10)} | {(10, 1)}
    assert all(found[i, 0] == "reparameterised" for i in range(5, 10)) and found[0, 0] == "exact"


def test_templates_take_a_numeral_as_one(spark):
    item = "Anna buys {} apples for {} dollars each and pays with {} dollars. How much change does she get"
    texts = [item.format(*v) for v in ((2.5, 1.25, "12.50"), ("1,200", 900, "2,000,000.5"), ("twenty five", "a hundred and six", "forty-two"), (4, "3/4", "3 million"))]
    texts[2] = texts[2].replace("a hundred", "one hundred")
    assert leaked(spark, [item.format(3, 2, 10)], texts) == {(i, 0): "reparameterised" for i in range(4)}
    data, offsets = text_bytes(pa.array(["2, 3. 4 one. two 5 six", "7"]))
    assert [list(t[1]) for t in decontaminate.readings(data, offsets)[-2:]] == [[0, 7, 8]] * 2


def test_short_items_are_reported_but_drop_nothing(spark):
    bounded_batches(spark)
    items = spark.createDataFrame([(1, "the"), (2, "What is it"), (3, "zinc loves plain warm water")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Here is the house. What is it for?"), (2, "They say zinc loves plain warm water in the end."), (3, "none of these")],
                                 "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.width for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 1): 1, (1, 2): 3, (2, 1): 1, (2, 3): 5}
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).orderBy("doc_id").collect()] == [1, 3]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items, least_width=1).collect()] == [3]


def test_every_item_is_searched_word_for_word(spark):
    items = ["12 + 7 = 19, 19 x 3 = 57, what is 57 minus 4", "Solve 3x = 12", "Bob", "Anna Maria Bauer, Karl Maier 7 kg 9 km", " . "]
    texts = [f"Some words stand here\n{i}\nand others follow, {i.lower()} too" for i in items]
    assert leaked(spark, items, texts + ["12 + 7 = 19, 19 x 3 = 58, what is 57", "Solve 3x = 13"]) == {(i, i): "exact" for i in range(4)}


def test_templates_brute_force(spark, docs):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    known = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 11):
            known[tuple(w[i:i + 12])].add(r.item_id)
    want = {(r.doc_id, item) for r in docs.collect() for w in [words(r.text)] for i in range(len(w) - 11) for item in known.get(tuple(w[i:i + 12]), ())}
    got = {(r.doc_id, r.item_id) for r in queries.op3_benchmark_templates(spark, SF).collect()}
    assert want <= got and len(got - want) <= 2


def test_ring(spark, docs):
    rows = queries.op4_hash_ring(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_ring_walk_by_hand():
    """The walk in pieces against one key at a time."""
    rng = random.Random(3)
    for _ in range(20):
        cells = 64
        counts = np.array([rng.choice([0, 0, 1, 5]) for _ in range(cells)])
        at, owner = sharding.ring(4, 3, cells)
        n = int(counts.sum())
        room = [n // 4 + (s < n % 4) for s in range(4)]
        pieces = sharding.walk(counts, list(room), at, owner)
        assert pieces.assign(k=pieces._high - pieces._low).groupby("shard").k.sum().reindex(range(4), fill_value=0).tolist() == room
        placed = {(c, r): s for c, low, high, s, _ in pieces.itertuples(index=False) for r in range(low, high)}
        assert len(placed) == n
        own = {c: int(owner[np.searchsorted(at, c) % len(at)]) for c in range(cells)}
        wanted = collections.Counter(own[c] for c in range(cells) for _ in range(counts[c]))
        kept = collections.Counter(s for (c, _), s in placed.items() if own[c] == s)
        assert all(kept[s] >= min(wanted[s], room[s]) for s in range(4))


def test_ring_moves_few(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = sharding.place(rows, ["doc_id"], 16, capacity=1.25).select("doc_id", F.col("shard").alias("a"))
    b = sharding.place(rows, ["doc_id"], 17, capacity=1.25).select("doc_id", F.col("shard").alias("b"))
    moved = a.join(b, "doc_id").filter("a <> b").count()
    assert moved < 0.2 * 20_000 and a.groupBy("a").count().agg(F.max("count")).first()[0] <= math.ceil(1.25 * 20_000 / 16)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_accuracy(spark, sf):
    sf = f"/root/testdata/{sf}"
    kept = {r.doc_id: r.keep for r in queries.op5_site_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert np.mean([kept[r.doc_id] for r in labels if r.quality and not r.toxic]) > 0.98
    assert np.mean([kept[r.doc_id] for r in labels if not r.quality]) < 0.05
    if sf.endswith("0.1"):
        assert np.mean([kept[r.doc_id] for r in labels if r.quality and r.toxic]) < 0.1


@pytest.mark.parametrize("sf, least", [("sf0.001", 0.6), ("sf0.01", 0.95)])
def test_toxic_words_found_on_texts_without_labels(spark, sf, least):
    """Five folds: toxic texts of a fold that hold an abusive English word, judged by the labels of the others."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    p = {}
    for i in range(5):
        model = quality.fit(docs, labels.filter(fold != i))
        left = docs.join(labels.filter((fold == i) & (F.col("quality") == 1)).select("doc_id", "toxic"), "doc_id")
        p.update({(r.doc_id, r.toxic, r.text): r.p_toxic for r in quality.evidence(left, model).collect()})
    abuse = re.compile("idiot|clown|loser|worthless|scum|moron|pathetic|disgusting|stupid|trash")
    assert np.mean([x > 0.5 for (_, toxic, text), x in p.items() if toxic and abuse.search(text.lower())]) >= least
    assert np.mean([x > 0.5 for (_, toxic, _), x in p.items() if not toxic]) <= 0.02


def test_forms_are_words_and_their_beginnings():
    texts = ["abcdefgh Abcdefgx", "abcde", None, "éééééé " + "z" * 30]
    hashes, rows, words = quality.forms(*text_bytes(pa.array(texts)))
    assert list(words) == [2, 1, 0, 2] and [int((rows == i).sum()) for i in range(4)] == [8, 1, 0, 14]
    sets = [set(hashes[rows == i]) for i in range(4)]
    assert len(sets[0]) == 5 and not sets[0] & sets[1] and len(sets[3]) == 14


@pytest.mark.parametrize("share, copies", [(0.12, 0), (0.35, 0), (0.6, 0), (0.12, 400)])
def test_lexicon_at_any_share_of_toxic_labels(spark, share, copies):
    bounded_batches(spark)
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    toxic = [i < share * 600 for i in range(600)]
    texts = [prose(40) + (f" bad{rng.randint(0, 2)} bad{rng.randint(0, 2)}" if t else "") for t in toxic]
    texts, toxic = texts + [" ".join(f"v{i}" for i in range(3_000))] * copies, toxic + [True] * copies
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    bad = word_hashes(*text_bytes(pa.array(["bad0 bad1 bad2"])), ALNUM)[0]
    assert set(bad) <= set(model[2]) and len(model[2]) < 20
    p = {r.doc_id: r.p_toxic for r in quality.evidence(docs, model).select("doc_id", "p_toxic").collect()}
    assert all((p[i] > 0.5) == toxic[i] for i in range(600))


def test_labels_that_no_word_tells_apart_give_the_prior(spark):
    """The same at every number of labels: a warning, and the rate of toxic labels as the probability of each text."""
    for n in (20, 200):
        docs = spark.createDataFrame([(i, f"same words w{i}") for i in range(n)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, 1, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
        with pytest.warns(UserWarning, match="no word"):
            model = quality.fit(docs, labels)
        assert all(abs(r.p_toxic - 0.5) < 0.01 for r in quality.evidence(docs, model).collect())


def test_site_rates_shrink(spark):
    rows = [("big", "x", 0.9)] * 300 + [("big", "x", 0.1)] * 100 + [("bad", "x", 0.1)] * 200 + [("new", "y", 0.1)]
    rates, overall = quality.site_rates(spark.createDataFrame(rows, "source string, lang string, p_own double"), ["source", "lang"])
    found = {r._site.split("\x1f")[0][1:]: r.p_site for r in rates.collect()}
    assert found["bad"] < 0.2 < found["new"] < found["big"] < 0.75 and abs(overall - np.mean([r[2] for r in rows])) < 1e-9


def test_licenses_brute_force(spark, docs):
    """Fuzzy notices by the pattern alone over the whole text, without seeds."""
    notices = tuple(licenses.NOTICES.items())
    rows = {r.doc_id: r for r in queries.op6_license_notices(spark, SF).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
        starts, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        got = rows[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert got.base_labels == ",".join(sorted(base))
        if len(words) < 300:
            normal = " ".join(words)
            any_fuzzy = {label for text, label, e, _, pattern in licenses.searchers(notices) if pattern.search(normal)}
            assert set(filter(None, got.labels.split(","))) - base <= any_fuzzy and bool(got.labels) == bool(any_fuzzy | base)


def test_license_edits():
    notices = tuple(licenses.NOTICES.items())
    got = licenses.scan_text("It is licenced under teh Apache License, Version 2.0!", tuple(licenses.PHRASES.items()), notices)
    assert got["labels"] == "apache-2" and got["spans"][0]["edits"] > 0 and got["spans"][0]["first_word"] == 2
    assert licenses.scan_text("nothing here", (), notices)["labels"] == ""


def test_license_matches_before_a_better_one():
    notices = tuple(licenses.NOTICES.items())
    found = licenses.notice_matches("relesed under the mit licens released under the mit license and relesed under the mit licens", notices)
    assert [f[3] for f in found] == ["mit"] * 3 and [f[0] for f in found] == [2, 0, 2]
    two = "licensd under the gnu generl public license version 3 or licensed under the gnu general public license version 2"
    assert [f[3] for f in licenses.notice_matches(two, notices)] == ["gpl-3", "gpl-2"]


def test_near_duplicates_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    idf = neardup.idf_table(docs)
    sets = {}
    for key, text in texts.items():
        words, at = word_hashes(*text_bytes(pa.array([text])), ALNUM)
        keys, n, _ = neardup.term_counts(pa.array([text]))
        sets[key] = np.repeat(keys, n)
    postings = collections.defaultdict(set)
    for key, s in sets.items():
        for x in set(s.tolist()):
            postings[x].add(key)
    pairs = {(a, b) for p in postings.values() if 1 < len(p) < 100 for a in p for b in p if a < b}
    parent = {k: k for k in texts}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if texts[a] == texts[b] or neardup.similarity(sets[a], sets[b], idf) >= neardup.THRESHOLD:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    by_text = {}
    for k in sorted(texts):
        first = by_text.setdefault(texts[k], k)
        x, y = find(k), find(first)
        parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in queries.op7_near_duplicates(spark, sf).collect()}
    assert got == {k: find(k) for k in texts}


def test_sampling_estimates_weighted_jaccard():
    rng = random.Random(5)
    idf = np.full(1 << neardup.DF_BITS, 1.0, np.float32)
    errors = []
    for _ in range(40):
        a = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        b = list(a)
        for _ in range(rng.randrange(1, 30)):
            b[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        column = pa.array([" ".join(a), " ".join(b)])
        signs, _ = neardup.signatures(column, idf)
        keys, n, at = neardup.term_counts(column)
        errors.append((signs[0] == signs[1]).mean() - neardup.similarity(keys[:at[1]], keys[at[1]:], idf))
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.12


def test_block_weights_match_similarity():
    rng = np.random.default_rng(2)
    idf = rng.uniform(1, 2, 1 << neardup.DF_BITS).astype(np.float32)
    pool = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    texts = [np.sort(rng.choice(pool, rng.integers(1, 90))) for _ in range(9)]
    common, wa, wb = neardup.common_weights(texts[:4], texts[4:], idf)
    for i in range(4):
        for j in range(5):
            assert abs(common[i, j] / (wa[i] + wb[j] - common[i, j]) - neardup.similarity(texts[i], texts[4 + j], idf)) < 1e-9


def test_warc_round_trip(spark, folder):
    full, _ = folder
    pages = spark.read.parquet(f"{full}/pages.parquet")
    place = shared_folder(spark)
    warc.write(pages, place)
    records = warc.read(spark, place).collect()
    payloads = {r.page_id: r.payload for r in records if r.record_type == "response"}
    assert payloads[5] == "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n" and payloads[6] == "<p>é&amp;" and payloads[2] == "" and payloads[4] == "<p>x</p>"
    assert sorted((r.page_id or 0, r.record_type) for r in records) == [
        (0, "revisit"), (1, "revisit"), (2, "response"), (4, "response"), (4, "response"), (5, "response"), (6, "response")]
    assert {r.page_id: r.refers_to for r in queries.op8_revisits(spark, full).collect()} == {1: 2, 2: None, None: 4, 4: None, 5: None, 6: None}


def test_a_hot_payload_meets_its_digest_in_many_groups(spark):
    rows = [(i, f"u{i % 900}", "<p>same</p>" if i % 3 == 0 else f"<p>{i // 2}</p>") for i in range(3_000)] + [(None, None, "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    place = shared_folder(spark)
    warc.write(pages, place, date="2030-05-06T07:08:09Z")
    found = warc.resolved(warc.read(spark, place), F.octet_length("payload").alias("n")).collect()
    top = {}
    for i, _, html_text in rows:
        top[html_text] = max(top.get(html_text, -1), -1 if i is None else i)
    want = sorted((-1 if i is None else i, top[t] if top[t] != i else -1, len(t)) for i, _, t in rows)
    assert sorted((-1 if r.page_id is None else r.page_id, -1 if r.refers_to is None else r.refers_to, r.n) for r in found) == want
    lines = spark.read.text(place).filter(F.col("value").startswith("WARC-Date")).distinct().collect()
    assert [r.value.strip() for r in lines] == ["WARC-Date: 2030-05-06T07:08:09Z"]
    left = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1), (None, 2)], "k string, i int")
    right = spark.createDataFrame([("a", 7)], "k string, v int")
    joined = collections.Counter((r.k, r.v) for r in salted_join(left, right, "k", ["i"]).collect())
    assert joined == {("a", 7): 500, ("b", None): 1, (None, None): 1}


def test_context_tree_brute_force(spark):
    """Counts, Krichevsky-Trofimov mixing and scores of a tiny corpus, node by node."""
    rows = [(1, "Abra cadabra"), (2, "abracadabra abra"), (3, "banana"), (4, ""), (5, None), (6, "an abracadabra, a cadabra"), (7, "é abra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") == 3
    got = {r.doc_id: r for r in lm.score(docs, held).collect()}
    counts, met = collections.Counter(), collections.Counter()
    stream = {k: b"\xff" * lm.DEPTH + (t or "").encode().lower() + b"\xff" for k, t in rows}
    def decisions(s, i):
        for k in range(8):
            yield (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1
    children = collections.defaultdict(set)
    for k, s in stream.items():
        for i in range(lm.DEPTH, len(s)):
            met.update(s[i - d:i] for d in range(lm.DEPTH + 1) if k != 3)
            for prefix, bit in decisions(s, i):
                for d in range(lm.DEPTH + 1):
                    context = s[i - d:i]
                    counts[context, prefix, bit] += k != 3
                    if d:
                        children[context[1:], prefix].add(context)
    def is_node(c):
        return len(c) <= lm.SPLIT or met[c] >= lm.LEAST
    def rest_of(c, p):
        return [sum(counts[x, p, bit] for x in children[c, p] if not is_node(x)) for bit in (0, 1)]
    def own(c, p):
        return block(counts[c, p, 0], counts[c, p, 1])
    def block(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    def weighted(c, p):
        if len(c) == lm.DEPTH:
            return own(c, p)
        below = sum(weighted(x, p) for x in children[c, p] if is_node(x)) + block(*rest_of(c, p))
        return np.logaddexp(own(c, p), below) - math.log(2)
    def one(context, p):
        out, rest = 0.0, 1.0
        for d in range(lm.DEPTH + 1):
            c = context[lm.DEPTH - d:]
            a, b = counts[c, p, 0], counts[c, p, 1]
            stop = 1.0 if d == lm.DEPTH else math.exp(own(c, p) - weighted(c, p) - math.log(2))
            out += rest * stop * (b + .5) / (a + b + 1)
            rest *= 1 - stop
            if d < lm.DEPTH and not is_node(context[lm.DEPTH - d - 1:]):
                a, b = rest_of(c, p)
                return out + rest * (b + .5) / (a + b + 1)
        return out
    for k, s in stream.items():
        total = sum(math.log10(one(s[i - lm.DEPTH:i], p) if bit else 1 - one(s[i - lm.DEPTH:i], p))
                    for i in range(lm.DEPTH, len(s)) for p, bit in decisions(s, i))
        assert abs(got[k].score - total) < 1e-5, k
        assert abs(got[k].bits_per_byte * (len(s) - lm.DEPTH) + total / math.log10(2)) < 1e-4
    assert got[3].held_out and not got[1].held_out and got[4].score == got[5].score
    assert any(len(c) > lm.SPLIT + 1 and n >= lm.LEAST for c, n in met.items())


def test_contexts_reach_past_a_word(spark):
    """Training texts cost clearly fewer bits a byte than held-out ones: the model knows them by more than their letters."""
    spent = collections.defaultdict(lambda: [0.0, 0])
    copies = collections.Counter(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op9_context_tree(spark, SF).collect():
        if copies[texts[r.doc_id]] == 1:
            spent[r.held_out][0] -= r.score / math.log10(2)
            spent[r.held_out][1] += r.n_bytes + 1
    (seen, a), (unseen, b) = spent[False], spent[True]
    assert seen / a < 0.9 * unseen / b


def test_packed_keys_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (lm._unpacked(lm._packed(keys), np.uint64) == keys).all() and len(lm._unpacked(lm._packed(keys[:0]), np.uint64)) == 0


def packed_block(texts):
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([i % 7 != 2 for i in range(n)]), pa.array(texts, pa.string()),
                                        pa.array([i % 2 for i in range(n)], pa.int32())], ["doc_id", "trains", "text", "block"])
    return pa.Table.from_batches(list(lm._packed_texts([batch.slice(0, 0), batch.slice(0, n // 3), batch.slice(n // 3)])))


def test_packed_texts_come_back():
    texts = ["", None, "\u00e9 b", "abc " * 30, "x", "", "\u4e2d"]
    found = {}
    for block in (0, 1):
        table = packed_block(texts).filter(pc.equal(pc.field("block"), block))
        data, offsets, trains = lm._texts(table)
        for i, a, b, t in zip(pc.list_flatten(table.column("ids")).to_pylist(), offsets, offsets[1:], trains):
            found[i] = data[a:b].tobytes().decode(), bool(t)
    assert found == {i: (t or "", i % 7 != 2) for i, t in enumerate(texts)}


def test_memory_of_a_bucket_follows_its_distinct_strings():
    """The strings that many blocks share are held once, not once a block."""
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 100_000).astype(np.uint64))
    row = {"block": 0, "bucket": 3, "grams": lm._packed(keys), "gram_n": lm._packed(np.full(len(keys), 2, np.uint32)), "words": None, "word_n": None}
    table = pa.Table.from_pylist([row] * 60, lm._COUNTS)
    lm._sums(table.slice(0, 1), "gram")
    tracemalloc.start()
    found, n = lm._sums(table, "gram")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == keys).all() and (n == 120).all()
    assert peak < 100_000_000


def test_cuts_change_no_string_node_or_score(monkeypatch):
    """Sorting in parts, subtrees in runs: the same counts, nodes and values as at once."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abA d\u00e9"), int(n))) for n in rng.integers(0, 90, 60)]
    table = packed_block(texts).filter(pc.equal(pc.field("block"), 0))
    def run():
        sent = lm._block_counts(table, 2)
        found = []
        for bucket in (0, 1):
            own = sent.filter(pc.equal(pc.field("bucket"), bucket))
            nodes = lm._bucket_nodes(own).sort_by([("prefix", "ascending"), ("context", "ascending")])
            top = nodes.filter(pc.greater_equal(pc.field("context"), 0)).select(["context", "prefix"])
            top = top.append_column("p", pa.array(np.full(len(top), 0.25))).append_column("rest", pa.array(1 / (2 + top.column("context").to_numpy() % 5)))
            found.append((own, nodes, lm._bucket_answers(own, top)))
        known = pa.concat_tables([f[2] for f in found])
        return found, lm._block_scores(known, table, 100, 10, 2)
    whole = run()
    trees = lm._trees(np.arange(0, 1 << 40, 1 << 31, dtype=np.uint64), np.ones(1 << 9))
    assert [(a, b) for a, b, _ in trees] == [(0, 1 << 9)]
    for name, value in (("CHUNK", 50), ("SORT_KEYS", 70), ("TREE_KEYS", 40)):
        monkeypatch.setattr(lm, name, value)
    runs = [(a, b) for a, b, _ in lm._trees(np.arange(0, 1 << 40, 1 << 31, dtype=np.uint64), np.ones(1 << 9))]
    assert len(runs) > 10 and all(a % 2 == 0 for a, _ in runs) and runs[-1][1] == 1 << 9
    cut = run()
    assert cut == whole


def test_buckets_are_exchanged_once(spark, capsys):
    rows = spark.range(100).select((F.col("id") % 11).cast("int").alias("bucket"), "id")
    tables = [t.name for t in spark.catalog.listTables()]
    dealt = written_in_buckets(rows, "bucket", 5)
    assert [t.name for t in spark.catalog.listTables()] == tables
    grouped = dealt.groupBy("bucket").applyInArrow(lambda t: t, "bucket int, id long")
    grouped.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert sorted(r.id for r in grouped.collect()) == list(range(100))
    assert written_in_buckets(rows.limit(0), "bucket", 5).groupBy("bucket").count().collect() == []


def test_unigram_base(spark, docs):
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) for r in docs.collect()}
    counts = collections.Counter()
    for k, w in words.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update([*w, "\0"])
    n, v = sum(counts.values()), len(counts)
    rows = queries.op9_context_tree(spark, SF).collect()
    assert len(rows) == len(words)
    for r in rows:
        w = [*words[r.doc_id], "\0"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        assert r.score < 0


def test_mixing(spark, docs):
    rows = queries.op10_mix(spark, SF).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = collections.Counter()
    taken = collections.Counter()
    for r in rows:
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    names = sorted(size)
    want = dict(zip(names, mixing.targets([size[s] for s in names])))
    for r in rows:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == size[source[r.doc_id]]
    assert all(taken[s] == min(int(want[s]), 2 * size[s]) for s in names)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, queries.op10_mix(spark, SF).collect()), key=str)


def test_targets():
    assert mixing.targets([10, 10, 10]) == [20.0, 25 / 3, 50 / 3]
    got = mixing.targets([1, 100, 1000, 0])
    assert got[3] == 0 and got[0] == 2 and abs(sum(got) - 1.5 * 1101) < 1e-9 and all(t <= 2 * s for t, s in zip(got, [1, 100, 1000, 0]))


def test_mixed_texts_have_the_words_taken(spark, docs):
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    mixed = mixing.mix(sized, keys=["doc_id", "text"])
    taken = mixed.agg(F.sum("taken")).first()[0]
    assert mixing.mixed_texts(mixed).agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken


def test_words_do_not_depend_on_cuts(monkeypatch):
    from pamspark.llm import common
    texts = pa.array(["alpha beta  gamma", None, "", "é x" * 50, LONG[:5000], "nowhitespace" * 40])
    whole = word_hashes(*text_bytes(texts), SPACED)
    monkeypatch.setattr(common, "CHUNK", 37)
    common._POWERS.clear()
    cut = word_hashes(*text_bytes(texts), SPACED)
    common._POWERS.clear()
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert len(whole[0]) == sum(len((t or "").split()) for t in texts.to_pylist())


def test_pipeline_keeps_clashing_columns(spark, docs):
    """Every internal name as a column of documents comes out as it went in, and decides nothing."""
    names = ["_cell", "_key", "_site", "_text_id", "_at", "_source", "_rank", "_low", "_high", "_slot", "_n", "_tid", "_size", "_words",
             "_ahead", "_before", "_budget", "part", "epochs", "epoch", "taken", "keep", "target", "source_size", "size", "class_id", "tid",
             "p_own", "block", "row", "extra_columns", "a.b"]
    marked = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    marked, plain = marked.withColumns({"shard": F.lit("own"), "slot": F.lit("own")}), docs
    for name, stage in corpus_pipeline.STAGES:
        marked = corpus_pipeline.written(stage(spark, marked, SF))
        plain = corpus_pipeline.written(stage(spark, plain, SF))
        for n in names:
            assert marked.filter(F.col(f"`{n}`") != F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string"))).count() == 0, (name, n)
        own = list(docs.columns)
        assert sorted(map(str, marked.select(own).collect())) == sorted(map(str, plain.select(own).collect())), name
    assert marked.schema["shard"].dataType.simpleString() == "int" and set(names) <= set(marked.columns)


def test_pipeline_stages(spark):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables, inputs = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        tables[name] = (inputs, corpus_pipeline.written(stage(spark, inputs, SF)))
        inputs = tables[name][1]
    for name in list(tables)[:-1]:
        assert tables[name][1].columns == docs.columns
    before, after = tables["near_duplicates"]
    assert after.count() == neardup.classes(before).select("class_id").distinct().count()
    before, after = tables["mixing"]
    words = lambda t: t.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words(after) - 1.5 * words(before)) <= 25
    before, after = tables["sharding"]
    sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert sum(sizes) == before.count() and max(sizes) - min(sizes) <= 1
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    good = {r.doc_id for r in tables["quality"][1].collect()}
    assert len(labels - good) <= 0.03 * len(labels)
