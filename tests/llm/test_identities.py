"""Texts without an id, and different texts of one id."""

import random

import cases
import pytest

from tidewheel.llm.common import on_workers
from tidewheel.llm.exact_dedup import drop_exact_copies, exact_dedup
from tidewheel.llm.jaccard_join import drop_near_copies, near_duplicates
from tidewheel.llm.suffix_dedup import repeated_passages


def sentence(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """A chain 1 - null - 2 of near copies, three more null ids, and id 7 on two texts; the last one of them shares a passage with a text of no id."""
    base, passage = sentence(0, 100), sentence(9, 60)
    middle, end = [*base[:96], *"abcd"], [*base[:92], *"efgh", *"abcd"]
    other = [" ".join(sentence(i, 30)) for i in range(1, 5)]
    return [(1, " ".join(base)), (None, " ".join(middle)), (2, " ".join(end)), (None, other[0]), (None, other[1]), (None, other[1] + "\n"), (7, other[2]), (7, " ".join([*sentence(6, 5), *passage])), (None, " ".join([*passage, *sentence(7, 5)])), (None, None), (7, "")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    on_workers(spark)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def test_exact_copies_by_text(frame, rows):
    plain = {"".join((t or "").split()) for _, t in rows}
    got = exact_dedup(frame).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(plain) == len({r.text_sha256 for r in got if r.kept})
    kept = drop_exact_copies(frame)
    assert kept.columns == frame.columns
    kept = [tuple(r) for r in kept.collect()]
    assert len(kept) == len(plain) == len({"".join((t or "").split()) for _, t in kept}) and set(kept) <= set(rows)


def test_near_copies_by_text(frame, rows):
    numbered = list(enumerate(t for _, t in rows))
    groups = {}
    for i, (_, c) in cases.near(numbered).items():
        groups.setdefault(c, []).append(rows[i][0])
    assert groups[0] == [1, None, 2]
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in groups.items()}
    expected = sorted((str(rows[i][0]), n, str(least[c])) for i, (n, c) in cases.near(numbered).items())
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(frame).collect()) == expected
    kept = drop_near_copies(frame).collect()
    of = {t: cases.near(numbered)[i][1] for i, t in numbered}
    assert len(kept) == len(groups) and {of[r.text] for r in kept} == set(groups)
    assert all(r.doc_id == least[of[r.text]] for r in kept)


def test_repeated_passages_by_text(frame):
    got = sorted((str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], r.first_doc_id) for r in repeated_passages(frame).collect())
    chain = [g for g in got if g[1] == 100]
    assert [(g[0], g[2][0], g[3]) for g in chain] == [("1", (0, 96), 1), ("2", (0, 92), 1), ("None", (0, 96), 1)]
    assert [g for g in got if g[1] == 65] == [("7", 65, [(5, 60)], 7), ("None", 65, [(0, 60)], 7)]
    assert len(got) == 5
