"""Source divergence against plain counting."""

import re
from collections import Counter, defaultdict

import pytest
from cases import documents, empty, lower

from tidewheel.llm.divergence import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    """[(lang, source, part, item, value, rank)] of (text, lang, source)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({r[1:] for r in rows})
    for text, lang, source in rows:
        got = Counter(TERM.findall(lower(text)))
        df[lang].update(got.keys())
        counts[lang, source].update(got)
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= 3]
        rates = {}
        for g in [s for la, s in groups if la == lang]:
            n = sum(counts[lang, g][t] for t in kept)
            rates[g] = {t: 1 + 10**9 * (counts[lang, g][t] + 1) // (n + len(kept)) for t in kept}
        total = {t: sum(counts[lang, s][t] for s in rates) for t in kept}
        n = sum(total.values())
        q = {t: 1 + 10**9 * (total[t] + 1) // (n + len(kept)) for t in kept}
        p = rates[source]
        pairs = [(sum((p[t] - r[t]) ** 2 // r[t] for t in kept), g) for g, r in rates.items() if g != source]
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:200])):
            out += [(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limit", [50_000, 0])
def test_equals_plain_counting(spark, limit):
    docs = documents(spark)
    names = ["a", "b", "é", None, ""]
    data = [(r.doc_id, r.text, r.lang, names[i % 5], "x", 1) for i, r in enumerate(docs.collect())]
    data += [(1, "\u0000only \u0001 twice", "xx", "s", "x", 1), (1, None, "xx", "t", "x", 1), (2, "A" * 50 + " Ä ä", "xx", "t", "x", 1), (3, "solo", "one", "s", "x", 1)]
    # columns named as the operator names its own
    given = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, term string, n long").repartition(5)
    got = divergence(given, broadcast_groups=limit)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert rows(got) == plain([(r[1], r[2], r[3]) for r in data])


def test_no_terms_and_no_documents(spark):
    assert rows(divergence(empty(spark))) == []
    given = spark.createDataFrame([(1, None, "en", "a"), (2, "..", "en", "b"), (3, "once", None, None)], "doc_id long, text string, lang string, source string")
    assert rows(divergence(given)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_blocks_cut_between_terms(spark, monkeypatch):
    import pyarrow as pa

    from tidewheel.llm import divergence as d

    t = pa.table({"tid": [1, 1, 2, 2, 2, 3, 4, 4]})
    parts = [p.column("tid").to_pylist() for p in d._whole_terms(iter(t.to_batches(2)), 3)]
    assert sum(parts, []) == t.column("tid").to_pylist()
    assert all(not set(a) & set(b) for i, a in enumerate(parts) for b in parts[i + 1 :])
