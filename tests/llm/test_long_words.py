"""Texts without spaces: words of any length."""

import random
import time

import cases
import numpy as np

from tidewheel.llm import sentencepieces
from tidewheel.llm.common import model_file, on_workers

PATH = model_file("piece_bpe_32k.model")


def test_whole_fixture_and_long_runs(spark):
    """Every text of the fixture, and runs of 5000 characters and of more than 2^20."""
    import sentencepiece

    on_workers(spark)
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(8)
    parts = ["the", "ing", "tion", "a", "x", "é", "漢", "字", "ß", "ไทย", "\U0001f600"]
    rows = [*enumerate(cases.texts()), (900, "".join(r.choice(parts) for _ in range(5000))), (901, "漢字" * 2500), (902, "ab" * ((1 << 19) + 50)), (903, "w" * 60), (904, "w" * 61), (905, "w" * 59)]
    got = {x.doc_id: x for x in sentencepieces.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].ids == own.encode(t or "") and got[i].n_tokens == len(got[i].ids) and got[i].round_trip


def test_steps_grow_with_the_word():
    encoded = sentencepieces.Model(PATH).long_word()
    word = "▁" + "".join(random.Random(2).choice("etaoinshr漢") for _ in range(200_000))
    start = time.monotonic()
    assert len(encoded(word)) > 10_000 and time.monotonic() - start < 30


def test_best_path():
    """Unigram models: against all segmentations, with characters that are no piece."""
    scores = {"a": -2.0, "b": -2.5, "ab": -3.2, "bc": -3.1, "abc": -9.0, "ca": -4.0, "cab": -5.5}
    known = {p: (i, s) for i, (p, s) in enumerate(scores.items())}
    r = random.Random(1)

    def best(w):
        ends = [i for i in range(1, len(w) + 1) if w[:i] in scores or i == 1]
        return max(scores.get(w[:i], -1000.0) + (best(w[i:]) if w[i:] else 0) for i in ends)

    for _ in range(60):
        w = "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
        b = sentencepieces._best_path(w, known, 3)
        assert b[0] == 0 and b[-1] == len(w) and np.isclose(sum(scores.get(w[x:y], -1000.0) for x, y in zip(b, b[1:])), best(w))
