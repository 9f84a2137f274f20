"""Each operator against a plain version, over awkward rows and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest

from tidewheel.llm import decontaminate, html_extract, jaccard_join, licences, quality, sentencepieces, token_counts
from tidewheel.llm import exact_dedup as exact_dedup_module
from tidewheel.llm.common import ALNUM_WORDS, Words, components, model_file, on_workers
from tidewheel.llm.exact_dedup import directory, drop_exact_copies, exact_dedup
from tidewheel.llm.sharding import difference, shard
from tidewheel.llm.suffix_dedup import repeated_passages

ROWS = list(enumerate(cases.texts()))


@pytest.fixture(scope="module")
def docs(spark):
    on_workers(spark)
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.empty(spark)


# 9 ------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(docs, none, bits):
    got = exact_dedup(docs, bucket_rows=4, hash_bits=bits).collect()
    assert len(got) == docs.count()
    plain = defaultdict(list)
    for r in docs.collect():
        plain[re.sub("[\x20\x09-\x0D]", "", r.text or "")].append(r)
    keep = {k: min(v, key=lambda r: (-len(r.text or ""), r.doc_id if r.doc_id is not None else 1e9)).doc_id for k, v in plain.items()}
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): (keep[k], len(v)) for k, v in plain.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_digest[r.text_sha256]
    assert sum(r.kept for r in got) == len(plain)
    assert exact_dedup(none).count() == 0
    assert drop_exact_copies(docs).count() == len(plain) and drop_exact_copies(docs).columns == docs.columns


def test_directory_doubles(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) key")
    cells, depth = directory(keys, 50)
    rows = cells.collect()
    assert depth >= 5 and len({r.cell for r in rows}) == len(rows) and all(0 <= r.local_depth <= depth for r in rows)
    sizes = defaultdict(int)
    by_cell = {r.cell: (r.bucket, r.local_depth) for r in rows}
    for (k,) in keys.collect():
        sizes[by_cell[(k % (1 << 64)) >> (64 - depth)]] += 1
    assert max(sizes.values()) <= 50 and sum(sizes.values()) == 2000
    assert directory(spark.range(500).selectExpr("7L key").distinct(), 1)[0].count() == 1


def test_directory_places_rows(spark, monkeypatch):
    """Owners are ranges of keys of about equal bytes; one bucket in place of the directory leaves all rows but those of the hot key with one owner."""
    docs = spark.range(600).selectExpr("id doc_id", "case when id % 3 = 0 then 'hot' else concat('text ', id % 350) end text")
    got = exact_dedup(docs, bucket_rows=8).collect()
    held, owned, keys = defaultdict(int), defaultdict(int), {}
    for r in got:
        held[r.bucket, r.local_depth] += 1
        owned[r.owner] += len(re.sub(" ", "", docs_text(r.doc_id))) + 1
    hot = {(r.bucket, r.local_depth) for r in got if docs_text(r.doc_id) == "hot"}
    assert len(hot) == 1 and len({r.owner for r in got if (r.bucket, r.local_depth) in hot}) > 5
    assert max(n for b, n in held.items() if b not in hot) <= 8 and len(held) > 40
    assert all(len({r.owner for r in got if (r.bucket, r.local_depth) == b}) == 1 for b in held if b not in hot)
    assert len(owned) > 20 and max(owned.values()) <= sum(owned.values()) / 8
    for r in got:
        norm = re.sub(" ", "", docs_text(r.doc_id))
        keys[norm] = r
    order = spark.createDataFrame([(k,) for k in keys], "norm string").selectExpr("norm", "shiftrightunsigned(xxhash64(norm), 1) k").orderBy("k").collect()
    placed = [keys[r.norm].owner for r in order if r.norm != "hot"]
    assert placed == sorted(placed)
    monkeypatch.setattr(exact_dedup_module, "directory", lambda k, *_: (k.selectExpr("0L cell", "0L bucket", "0 local_depth", "weight").groupBy("cell", "bucket", "local_depth").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "weight"), 0))
    flat = exact_dedup(docs, bucket_rows=8).collect()
    assert len({r.owner for r in flat if (r.bucket, r.local_depth) not in hot}) == 1
    same = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r[c] for c in same) for r in flat) == sorted(tuple(r[c] for c in same) for r in got)


def docs_text(i: int) -> str:
    return "hot" if i % 3 == 0 else f"text {i % 350}"


# 4 ------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [12, 1])
def test_jaccard_join(docs, none, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", cell)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 12 if cell > 1 else 2)
    expected = cases.near(ROWS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got.pop(None) == (1, None)
    assert got == expected
    if cell > 1:
        assert jaccard_join.near_duplicates(none).count() == 0
        assert jaccard_join.drop_near_copies(docs).count() == len({c for _, c in expected.values()}) + 1


def test_jaccard_join_of_a_dense_group(spark):
    """Many texts around a centre, some beyond the threshold from it but near each other: one large cell."""
    on_workers(spark)
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            w[r.randrange(150)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == cases.near(rows)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {n: c for n, c in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 ------------------------------------------------------------------------------


def test_decontamination(spark, docs, none, monkeypatch):
    long = [t for _, t in ROWS if t and len(t.split()) > 30]
    items = [(1, long[0]), (20, " ".join(long[3].upper().split()[5:25])), (3, "one"), (4, "One, TWO!"), (5, None), (6, "..."), (1, long[0]), (7, " ".join(long[4].split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_LIMIT", 300)
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == docs.count()
    by_id = dict(ROWS)
    for r in got:
        n, hit, names = cases.hits(by_id.get(r.doc_id, "text of no id"), items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_by_all_suffixes():
    """Longest matches against a comparison of every pair of places, in words of few letters, so that windows repeat and overlap."""
    r = random.Random(2)
    for _ in range(60):
        def seq(n):
            return [r.choice("abc") for _ in range(n)]

        items, rows, window = [seq(r.choice([0, 1, 3, 9, 14])) for _ in range(3)], [seq(r.randrange(40)) for _ in range(3)], r.choice([2, 4, 10])
        rows.append(items[0] + ["x"] + items[1])
        plain = []
        for d, row in enumerate(rows):
            for i, item in enumerate(items):
                for p, q in itertools.product(range(len(row)), range(len(item))):
                    n = 0
                    while p + n < len(row) and q + n < len(item) and row[p + n] == item[q + n]:
                        n += 1
                    if n >= min(window, len(item)) and not (p and q and row[p - 1] == item[q - 1]):
                        plain.append((d, i, q, p, n))
        words = Words(pa.array([" ".join(x) for x in rows], pa.large_string()), ALNUM_WORDS)
        got = decontaminate.matches(words, decontaminate.Items(["i"] * 3, [" ".join(x) for x in items], window))
        assert sorted(map(tuple, got.tolist())) == sorted(plain)


def test_decontamination_searches_near_windows_only():
    """However long the benchmark, only test suffixes whose window the shard has are searched."""
    r = random.Random(3)
    items = [" ".join(f"w{r.randrange(50)}" for _ in range(60)) for _ in range(300)]
    held = decontaminate.Items(list(range(300)), items, 10)
    words = Words(pa.array([" ".join(f"w{r.randrange(50)}" for _ in range(5000)), items[7]], pa.large_string()), ALNUM_WORDS)
    covered, query = held.near(words)
    assert int(covered.sum()) == 60 and len(query) == 51 and set(held.item[held.at[query]]) == {7}
    assert decontaminate.matches(words, held).tolist() == [[1, 7, 0, 0, 60]]


# 6 ------------------------------------------------------------------------------


def test_sharding(docs, none):
    for chunk in (4096, 7):
        got = shard(docs, chunk=chunk).toPandas()
        assert len(got) == docs.count() and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
    text = {r.doc_id: r.text for r in docs.collect()}
    home = {}
    for r in got.itertuples():
        t = text[None if np.isnan(r.doc_id) else int(r.doc_id)]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert home.setdefault(t, r.shard) == r.shard
    assert shard(none).count() == 0


def test_differencing_is_tight():
    r = np.random.default_rng(1)
    sums = np.zeros((500, 8), np.int64)
    sums[:, 0] = r.integers(1, 10_000, 500)
    place, total = difference(sums)
    assert total.sum() == sums.sum() and total.max() - total.min() < 50
    assert (np.bincount(place[:, 0], sums[:, 0], 8) == total).all()
    place, total = difference(np.array([[5, 0]]))
    assert place.tolist() == [[0, 1]] and total.tolist() == [5, 0]


# 10 -----------------------------------------------------------------------------


def test_repeated_passages(docs, none):
    plain = [*ROWS, *[(1000 + i, dict(ROWS)[3]) for i in range(2)]]
    expected = {i: s for i, s in cases.repeats(plain).items() if i < 1000}
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeated_passages(docs).collect()}
    assert got == expected
    assert repeated_passages(none).count() == 0


# 1 ------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>"</script></head><body><header><a href=/>Site</a></header>
<div class="menu"><a href=1>Home</a> <a href=2>About</a></div><div id="cookie-notice">We use cookies on this site.</div><article><h1>The  title</h1>
<p><b>First &lt;paragraph&gt; of the text,<br>on two lines.<p>Second &eacute;&#33;</p><ul><li>one<li>two</ul><form><input><button>Send</button></form>
<aside>Related things that nobody wants.</aside></article><div class="sidebar"><p>A long text beside the article that is not part of it at all.</p></div>
<section id=comments><p>I liked this article very much, thank you for it.</p></section><footer>&copy; site</footer><foot"""


def test_extraction(spark, none):
    text, seen = html_extract.extract(PAGE)
    assert text == "The title\nFirst <paragraph> of the text, on two lines.\nSecond é!\none\ntwo" and seen > 8
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (3, "v", "", ""), (None, "w", "<p>Just a paragraph of plain text with nothing around it.", ""), (5, "", "<" * 2000 + "p>", ""), (6, "", "<div>" * 3000 + "deep text that goes on.", ""), (7, "", "no tags, only words.", "")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == text and by_id[2] == by_id[3] == "" and by_id[None].startswith("Just a paragraph") and "deep text" in by_id[6]
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_minimum_cut_is_minimum():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 8)
        c, b = [r.uniform(0, 3) for _ in range(n)], [r.uniform(0, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1)) for i in range(n) for j in range(i) if r.random() < 0.4]

        def cost(label):
            return sum(b[i] if label[i] else c[i] for i in range(n)) + sum(w for i, j, w in edges if label[i] != label[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(c, b, edges)) == pytest.approx(best, abs=0.02)


def test_edges_decide_where_blocks_say_little():
    """A page without names of classes: a short line is kept among paragraphs and dropped among links; alone it could be either."""
    long = "This paragraph has a good number of words in it, so that it looks like text, and it ends as sentences do."
    page = f"<div><div>{long} One.</div><div>See below</div><div>{long} Two.</div></div><div><a href=1>News of the day</a><br></div><div>See below</div><div><a href=2>Sports and more</a></div>"
    found = html_extract.parse(page)
    alone = [c > b for c, b in map(html_extract.costs, found)]
    text, _ = html_extract.extract(page)
    assert text.split("\n") == [f"{long} One.", "See below", f"{long} Two."]
    assert len({a for a, b in zip(alone, found, strict=True) if b.text == "See below"}) == 1


def test_long_pages_take_time_in_proportion():
    import time

    page = "<p>A paragraph of some words that is kept, with a full stop.</p><ul class=menu><li><a href=x>Menu</a></li></ul>"
    start = time.monotonic()
    text, seen = html_extract.extract(page * 12000)
    assert seen == 24000 and text.count("\n") == 11999 and time.monotonic() - start < 20


# 2 and 3 ------------------------------------------------------------------------


def test_token_counts(spark, docs, none, tmp_path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(model_file("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = str(tmp_path / "docs")
    docs.write.parquet(table)
    by_id = dict(ROWS)
    for block in (1 << 20, 5):
        got = token_counts.token_counts(spark.read.parquet(table), block_tokens=block).collect()
        assert len(got) == docs.count()
        assert all(r.n_tokens == len(own.encode_ordinary(by_id.get(r.doc_id, "text of no id") or "")) for r in got)
    none.write.parquet(str(tmp_path / "none"))
    assert token_counts.token_counts(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_scan_of_bare_files(spark, tmp_path):
    """Documents over many blocks, empty ones, and a last one that has not ended."""
    on_workers(spark)
    tokens = np.array([3, 4, 0, 0, 5, 6, 7, 8, 9, 1, 2, 3, 4, 0, 7], "<u2")
    (tmp_path / "part-0.txt").write_bytes(tokens.tobytes())
    (tmp_path / "part-1.txt").write_bytes(b"")
    for block in (1, 2, 3, 100):
        got = token_counts.scan_tokens(spark, str(tmp_path), block).orderBy("document").collect()
        assert [(r.document, r.n_tokens, r.ended) for r in got] == [(0, 2, True), (1, 0, True), (2, 9, True), (3, 1, False)]


def test_sentencepieces(docs, none):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model_file("piece_bpe_32k.model"))
    by_id = dict(ROWS)
    small = docs.filter("length(text) < 2000 or text is null")
    got = sentencepieces.encode_and_decode(small).collect()
    assert len(got) == small.count()
    for r in got:
        assert r.ids == own.encode(by_id.get(r.doc_id, "text of no id") or "") and r.n_tokens == len(r.ids) and r.round_trip
    apart = sentencepieces.decode(sentencepieces.encode(small, bucket_bytes=3000)).collect()
    assert len(apart) == len(got) and all(r.decoded == (r.text or "") for r in apart)
    nulls = sentencepieces.decode(small.selectExpr("doc_id", "cast(null as array<int>) ids"))
    assert nulls.filter("decoded is not null").count() == 0
    assert sentencepieces.encode_and_decode(none).count() == 0


def test_long_words_by_the_same_rule(spark):
    """Words beyond 60 characters take the other way to the same pieces."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model_file("piece_bpe_32k.model"))
    model = sentencepieces.Model(model_file("piece_bpe_32k.model"))
    r = random.Random(4)
    words = ["▁" + "".join(r.choice(["the", "ing", "tion", "a", "x", "é", "漢", "ß"]) for _ in range(n)) for n in (5, 20, 40, 60)]
    got = sentencepieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()
    for x in got:
        assert model.identifiers(np.array(x.places)).tolist() == own.encode(x.word[1:])


def test_viterbi(spark):
    """The fold for unigram models against all segmentations."""
    scores = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.2, "bc": -3.1, "abc": -9.0, "ca": -4.0, "cab": -5.5}
    pieces = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(scores.items())], "piece string, place long, score double")
    r = random.Random(1)
    words = list({"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(40)})

    def best(w):
        return max(((scores[w[:i]] + (best(w[i:])[0] if w[i:] else 0), [w[:i], *(best(w[i:])[1] if w[i:] else [])]) for i in range(1, len(w) + 1) if w[:i] in scores), key=lambda x: x[0])

    found = sentencepieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), pieces, 3).withColumn("b", sentencepieces.best_bounds(True))
    for x in found.collect():
        parts = [x.word[a:b] for a, b in zip(x.b, x.b[1:])]
        assert "".join(parts) == x.word and sum(scores[p] for p in parts) == pytest.approx(best(x.word)[0])


# 7 ------------------------------------------------------------------------------


def test_licences(spark, docs, none):
    mit = licences.KNOWN[0][1]
    texts = [mit, mit.upper().replace("License", "LICENCE"), mit.replace("<year> <holder>", "1999 Somebody, Inc.").replace("\n\n", "\n"), mit + " and more", "a\nReleased under the MIT Licence\nLICENSED UNDER CC BY-NC 4.0!\nb", None, "", "©"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licence string")
    got = {r.doc_id: (r.licence, r.n_notices, r.notices) for r in licences.scan(frame).collect()}
    assert [got[i][0] for i in range(4)] == ["MIT", "MIT", "MIT", None]
    assert got[4] == (None, 2, "CC-BY-NC-4.0,MIT") and got[5] == got[6] == got[7] == (None, 0, "")
    assert licences.scan(docs).count() == docs.count() and licences.scan(none).count() == 0


def test_whole_licences(spark, monkeypatch):
    """Every licence of the table as a whole text, wrapped, with another holder and quotes of another kind; opposite clauses differ."""
    whole = [(n, t) for n, t in licences.KNOWN if len(t) > 200]
    texts = [(n, t.replace("<year>", "2031").replace("<holder>", "A. N. Other").replace('"AS IS"', "\u201cAs is\u201d").replace(" the ", "\nthe ")) for n, t in whole]
    texts += [(None, "(c) You must retain this.\nx"), (None, "(c) You need not retain this.\nx"), (None, whole[0][1].replace("without restriction", "with restriction"))]
    for name, path in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0")):
        try:
            with open(f"/usr/share/common-licenses/{path}", encoding="utf-8") as f:
                texts.append((name, f.read().upper()))
        except FileNotFoundError:
            pass
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = sorted(licences.scan(frame).collect())
    assert [r.licence for r in got] == [n for n, _ in texts]
    assert len({r.text_digest for r in got}) == len(got)
    few = licences.scan(frame).collect()
    monkeypatch.setattr(licences, "MOST_KNOWN", 3)
    assert sorted(licences.scan(frame).collect()) == sorted(few)


# 8 ------------------------------------------------------------------------------


def labelled(spark, n=1500, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        kind = r.choice([0, 1, 2, 2, 2])
        if kind == 0:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["nasty", "vile", "rotten"])
        rows.append((i, (" | " if kind == 1 else " ").join(w)))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    labels += [(None, 1, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_rows_it_has_not_seen(spark, docs, none):
    on_workers(spark)
    frame, labels = labelled(spark)
    train, test = labels.filter("doc_id < 1000 or doc_id is null"), labels.filter("doc_id >= 1000")
    got = quality.classify(frame.filter("doc_id >= 1000"), train).withColumnRenamed("keep", "kept")
    # the classifier is fitted on documents that are at hand, so it gets all of them
    model = quality.train(frame, train)
    scored = quality.score(frame.filter("doc_id >= 1000"), model).join(quality.graded(test), "doc_id").collect()
    right = sum((r._score["tails"][-1] >= 0.5) == (r.grade == 2) for r in scored)
    assert right / len(scored) > 0.97
    assert all(r._score["tails"] == sorted(r._score["tails"], reverse=True) for r in scored)
    assert got.count() == 500
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).filter("keep").count() == docs.count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_features_of_awkward_texts():
    row, bucket, value = quality.features(pa.array([None, "", "a", "| | |"], pa.string()))
    assert len(row) == len(bucket) == len(value) and np.isfinite(value).all()
