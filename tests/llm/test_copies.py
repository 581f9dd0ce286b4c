"""The near-duplicate join on several hundred near copies of one text, which fill several blocks, and on passages that many documents share."""

import random

import numpy as np

from zonecast.llm import setjoin


def brute(texts, words, percent):
    sets = {}
    for d, t in texts:
        w = t.lower().split()
        size = min(words, len(w))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}


def test_hundreds_of_near_copies(spark):
    r = random.Random(11)
    prose = lambda n: [f"v{r.randrange(4000)}" for _ in range(n)]
    base, passage, texts = prose(90), prose(60), []
    for _ in range(620):  # a chain: copies of copies drift from the first
        own = list(base if r.random() < 0.5 or not texts else r.choice(texts).split())
        own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(prose(r.randint(0, 40)) + passage + prose(r.randint(0, 12))) for _ in range(150)]
    texts += [" ".join(passage), " ".join(passage), "", "one two"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for words, percent in ((3, 90), (5, 80)):
        got = {x.doc_id: x.component_id for x in setjoin.join_components(docs, words, percent).collect()}
        want = brute(rows, words, percent)
        assert got == want and max(list(want.values()).count(x) for x in set(want.values())) > 300


def test_frequent_tokens_only_change_the_order():
    r = np.random.default_rng(3)
    tokens = np.sort(r.integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2))
    known = tokens[r.permutation(200)[:150]]
    frequent = (np.sort(known), r.integers(3, 9, 150).astype(np.int32))
    for percent in (50, 80, 90):
        p = setjoin.reach(len(tokens), percent)
        plain, own = setjoin.columns(tokens, percent, (tokens[:0], np.empty(0, np.int32))), setjoin.columns(tokens, percent, frequent)
        assert len(plain) >= p and len(own) >= p and set(own) <= set(tokens) and len(set(own)) == len(own)
        rare = np.setdiff1d(tokens, known)
        assert set(rare) <= set(own) if p >= len(rare) else not set(own) & set(known)
