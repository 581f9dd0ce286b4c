"""op2's counting and dictionaries: what recurs is gone through once, and a block's dictionary is one row."""

import random

import numpy as np
import pandas as pd

from zonecast.llm import lmscore


def _texts():
    r = random.Random(4)
    found = pd.DataFrame({"code": range(51), "word": [None] * 45 + [f"new{chr(97 + i)}" for i in range(6)], "leaf": [*range(40), *[np.nan] * 11], "c": [*range(60, 20, -1), *[2] * 5, *[1] * 3, *[0] * 3]})
    code = lmscore.WordCode(list(range(60, 20, -1)), 10, 5, 12, [i % 7 for i in range(256)])
    texts = [np.array([min(50, int(r.expovariate(0.1))) for _ in range(n)], np.int32) for n in (0, 1, 70, 300, 5, 130)]
    return texts, found, code


def test_words_that_recur_are_counted_first(monkeypatch):
    texts, found, code = _texts()
    for learner in (True, False):
        own = lmscore.Texts(code, found, learner)
        assert (lmscore.sightings(texts, own) == sum(events.sightings() for _, events, *_ in own.groups(texts))).all()
    assert not lmscore.sightings(texts[:1], own).sum() == 0  # its end
    leaves, path = [0], lmscore.Code.path

    def counted(self, x):
        leaves[0] += len(x) if self is code else 0
        return path(self, x)

    monkeypatch.setattr(lmscore.Code, "path", counted)
    lmscore.sightings([texts[3]], own)
    once, leaves[0] = leaves[0], 0
    lmscore.sightings([texts[3]] * 50, own)
    assert leaves[0] == once


def test_a_block_has_one_row_of_dictionary(spark):
    _, found, _ = _texts()
    rows = [(b, int(x.code), x.word, None if np.isnan(x.leaf) else int(x.leaf), int(x.c)) for b in ("x", "y") for x in found.sample(frac=1, random_state=1).itertuples()]
    got = lmscore.packed(spark.createDataFrame(rows, "of string, code int, word string, leaf int, c long"))
    assert sorted(r.of for r in got.select("of").collect()) == ["x", "y"] and lmscore.packed(got) is got
    for _, one in got.toPandas().groupby("of"):
        pd.testing.assert_frame_equal(lmscore._unpacked(one), found.astype({"code": "int64"}), check_dtype=False)
    assert not len(lmscore._unpacked(got.limit(0).toPandas()))
