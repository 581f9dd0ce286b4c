"""Each operator against a brute-force version, on a small table of ordinary and odd documents."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from zonecast.llm import components, exactdedup, hosts, langid, linededup, lmscore, mixing, packing, quality, setjoin, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = [prose(r.randint(20, 200)) for _ in range(25)]
    near = []
    for text in base[:12]:
        for _ in range(3):
            own = text.split()
            own[r.randrange(len(own))] = "zz"
            near.append(" ".join(own))
    odd = [None, "", " \n ", "one", "two words", "Ünïcode ＡＢＣ 漢字 😀 \x00 end", "a" * 5000, "x y z " * 1500, "line\n" * 30, "common line\n" + prose(30), "<|endoftext|> tail", base[0].upper(), "1234 !!"]
    odd += [f"shared passage here\n  Common Line \n{prose(20)}" for _ in range(12)]
    return base + base[:5] + near + odd


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "ü")[i % 4] if i % 7 else "a", None if t is None else len(t)) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(docs, rows, spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    docs.withColumnsRenamed({}).selectExpr("*", "1 AS kept", "'x' AS n_words", "2 AS size", "3 AS component_id").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, "http://A.example.com/en/1?x"), (1, None), (2, "no scheme"), (3, "x://b.example.com/en/7#y"), (4, "http://example.net/de/8")], "page_id long, url string").write.parquet(f"{out}/pages.parquet")
    return f"file://{out}"


def run(spark, folder, prefix):
    name = next(q for q in entry.queries() if q.startswith(prefix))
    return entry.queries()[name](spark, folder).collect()


def test_base_counts(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op1_")}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        w, r = words(text), got[i]
        n, seen = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if n[tuple(w[k : k + 3])] > 1:
                seen |= {k, k + 1, k + 2}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(seen))
        assert r.base_failed == (len(w) < 50 or 100 * len(seen) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_verdicts_of_quality(spark, folder, rows):
    """kept, recomputed: histograms of classes and common words against the sums over the other texts of the language."""
    import regex

    r = quality.QualityRules()
    classes = [regex.compile(f"[{x}]") for x in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"\x20\x09-\x0D", r".,;:?'\"()\-", "!", "#*$%&|<>")]
    langs, hist = list(r.common_words), {}
    for i, t, *_ in rows:
        text, w = t or "", [low(x) for x in words(t)]
        hits = [sum(x in r.common_words[lang] for x in w) for lang in langs]
        lang = langs[hits.index(max(hits))] if max(hits) else ""
        seen, left = [], list(text)
        for c in classes:
            seen.append(sum(c.fullmatch(x) is not None for x in left))
            left = [x for x in left if c.fullmatch(x) is None]
        common = [w.count(x) for x in r.common_words[lang]] if lang else [0]
        hist[i] = lang, [*seen, len(left)], [*common, len(w) - sum(common)], len(text), len(w)

    def distance(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        return math.sqrt(max(0.0, part(p, q) / 2 + part(q, p) / 2))

    sums = {lang: [np.sum([h[k] for h in hist.values() if h[0] == lang], axis=0) for k in (1, 2)] for lang in {h[0] for h in hist.values()}}
    got = {x.doc_id: x for x in run(spark, folder, "op1_")}
    for i, (lang, seen, common, n_chars, n_words) in hist.items():
        far = n_chars >= r.min_chars_judged and distance(seen, sums[lang][0] - seen) > r.max_class_distance
        far |= lang != "" and n_words >= r.min_words_judged and distance(common, sums[lang][1] - common) > r.max_word_distance
        assert got[i].kept == (not got[i].base_failed and not far), i
    assert len({x.kept for x in got.values()}) == 2


def test_distance_of_same_and_apart(spark):
    from pyspark.sql import functions as F

    a, b, z = (F.array(*map(F.lit, x)) for x in ([1, 3], [2, 6], [0, 0]))
    far = quality.distance(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(5)))
    assert [round(x, 9) for x in spark.range(1).select(quality.distance(a, b), far, quality.distance(a, z)).first()][:2] == [0, 1]


def test_base_score_and_held_out(spark, folder, rows):
    taught = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    c = collections.Counter(w for i, t, *_ in rows if i in taught for w in words(low(t)))
    c["\n"] = len(taught)
    total, distinct = sum(c.values()), len(c)
    got = {r.doc_id: r for r in run(spark, folder, "op2_")}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        own, r = [*words(low(text)), "\n"], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in taught, len(own), sum(c[w] > 0 for w in own), total)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)) < 1e-6 and r.score < 0


def _language_model(seed=0):
    """A code of 40 words and texts over it, some words rarer or unknown, with the cells of their own sightings."""
    import pandas as pd

    r = random.Random(seed)
    names = [f"w{i}" for i in range(40)] + [f"rare{i}" for i in range(5)] + [f"new{chr(97 + i)}" for i in range(6)]
    found = pd.DataFrame({"code": range(51), "word": names, "leaf": [*range(40), *[np.nan] * 11], "c": [*range(60, 20, -1), *[2] * 5, *[0] * 6]})
    code = lmscore.WordCode(list(range(60, 20, -1)), 10, 5, 12, [i % 7 for i in range(256)])
    texts = [np.array([min(50, int(r.expovariate(0.1))) for _ in range(n)], np.int32) for n in (0, 1, 70, 300, 5, 130)]
    own = lmscore.Texts(code, found, False)
    counts = sum(events.sightings() for _, events, *_ in own.groups(texts[3:]))
    mixer = lmscore.Mixer()
    mixer.weights += np.random.default_rng(seed).normal(0, 0.05, mixer.weights.shape)
    return texts, own, counts, mixer


def _bit_by_bit(text, own, counts, mixer):
    """The bits of one text, one bit after the other: sightings in the text are counted at once, weights after each block."""
    code, cost, local = own.code, 0.0, collections.Counter()
    weights, refined, waiting = mixer.weights.copy(), mixer.refined.copy(), []
    start, half = len(code.offsets), lmscore.LEVELS // 2
    leaves = [start, start, *own.leaf[text].tolist(), code.end]
    stretch = lambda z, o: min(8.0, max(-8.0, math.log((o + lmscore.DELTA) / (z + lmscore.DELTA))))

    def bit_of(x, gate, bit):
        nonlocal cost
        dot = float(np.dot(weights[gate], x))
        mixed = 1 / (1 + math.exp(-max(-12, min(12, dot))))
        level = int(np.clip(np.rint(dot * half / lmscore.LIMIT), -half, half)) + half
        zero, one = refined[gate, level]
        p = min(1 - 1e-5, max(1e-5, (mixed + one / (zero + one)) / 2))
        cost -= math.log2(p if bit else 1 - p)
        waiting.append((gate, level, bit, (bit - mixed) * np.array(x)))

    def cells(kind, node, *context):
        at = int(lmscore.slot(kind, np.array([node]), *(np.array([c]) for c in context))[0])
        return int(counts[2 * at]), int(counts[2 * at + 1])

    for i, leaf in enumerate(leaves[2:]):
        if i and i % lmscore.STEP == 0:
            n = collections.Counter(g for g, *_ in waiting)
            for gate, level, bit, step in waiting:
                weights[gate] += lmscore.RATE / math.sqrt(n[gate]) * step
                refined[gate, level, bit] += 1
            waiting.clear()
        for depth, at in enumerate(range(code.offsets[leaf], code.offsets[leaf + 1])):
            node, bit = int(code.nodes[at]), int(code.bits[at])
            one, two = cells(1, node, leaves[i + 1]), cells(2, node, leaves[i + 1], leaves[i])
            here = local[node, 0] + local[node, 1]
            gate = (min(depth, 5) * 3 + (here > 0) + (here > 3)) * 3 + (sum(one) > 0) + (sum(one) > 7)
            bit_of([code.stretched[node], stretch(*one), stretch(*two), stretch(local[node, 0], local[node, 1]), 0.3], gate, bit)
            local[node, bit] += 1
        if leaf == code.unknown:
            data = own.words[text[i]] + b"\0"
            for k, byte in enumerate(data):
                past = [data[k - j] if k >= j else 0 for j in (1, 2, 3)]
                for depth, at in enumerate(range(code.letters.offsets[byte], code.letters.offsets[byte + 1])):
                    node, bit = int(code.letters.nodes[at]), int(code.letters.bits[at])
                    seen = [cells(3 + j, node, *past[:j]) for j in range(4)]
                    gate = lmscore.WORD_GATES + min(depth, 7) * 3 + (sum(seen[3]) > 0) + (sum(seen[3]) > 3)
                    bit_of([*(stretch(*c) for c in seen), 0.3], gate, bit)
    return cost


def test_mixing_is_that_of_one_bit_after_the_other(monkeypatch):
    texts, own, counts, mixer = _language_model()
    got = lmscore.score(texts, own, lmscore.Cells(counts), mixer)[0]
    assert np.allclose(got, [_bit_by_bit(x, own, counts, mixer) for x in texts], rtol=1e-4)
    monkeypatch.setattr(lmscore, "SLICE", 2 * lmscore.STEP)
    assert np.allclose(lmscore.score(texts, own, lmscore.Cells(counts), mixer)[0], got, rtol=1e-5)


def test_bits_are_a_distribution():
    """Over all words of the tree that may come next, probabilities sum to one; the order of words counts."""
    texts, own, counts, mixer = _language_model()
    cells, past = lmscore.Cells(counts), texts[2]
    price = lambda x: lmscore.score([np.array(x, np.int32)], own, cells, mixer)[0][0]
    known = list(range(41))  # a rarer word stands for all of them
    assert 0.5 < sum(2.0 ** (price([*past[:9]]) - price([*past[:9], i])) * 2.0 ** (_end_cost(own, cells, mixer, [*past[:9], i]) - _end_cost(own, cells, mixer, [*past[:9]])) for i in known) < 1
    assert abs(price(past) - price(past[::-1])) > 1e-3


def _end_cost(own, cells, mixer, text):
    """Bits of the end after text."""
    code = own.code
    group = own._events([(0, 0, len(text) + 1)], [np.array(text, np.int32)])
    events = group[1]
    zero, one = lmscore._earlier(events.node, events.bit[: events.words])
    x, gate = lmscore.inputs(events, code, cells, zero, one, False)
    n = code.offsets[code.end + 1] - code.offsets[code.end]
    own_bits = slice(events.words - n, events.words)
    dot = (mixer.weights[gate[own_bits]] * x[:, own_bits].T).sum(axis=1)
    level = np.clip(np.rint(dot * (lmscore.LEVELS // 2) / lmscore.LIMIT), -8, 8).astype(int) + lmscore.LEVELS // 2
    held = mixer.refined[gate[own_bits], level]
    p = (lmscore.squash(dot) + held[:, 1] / held.sum(axis=1)) / 2
    return -np.log2(np.where(events.bit[own_bits] == 1, p, 1 - p)).sum()


def test_the_start_of_the_mixer_comes_from_all_blocks(spark):
    import pandas as pd

    r = random.Random(3)
    n = 60
    found = pd.DataFrame({"code": range(n), "word": None, "leaf": [float(i) for i in range(40)] + [None] * (n - 40), "c": [9] * n})
    code = lmscore.WordCode(list(range(60, 20, -1)), 10, 5, 12, [i % 7 for i in range(256)])
    texts = [np.array([min(n - 1, int(r.expovariate(0.02 * (b + 1)))) for _ in range(80 + 10 * b)], np.int32) for b in range(9)]
    held = spark.createDataFrame([(f"b{min(b, 7)}", str(b), 1, bytearray(x.tobytes()), True) for b, x in enumerate(texts)] + [("b8", "x", 1, bytearray(), False)], "block string, doc_id string, n_bytes long, codes binary, taught boolean")
    back = spark.createDataFrame([(f"b{b}", i, None, i if i < 40 else None, 9) for b in range(9) for i in range(n)], "of string, code int, word string, leaf int, c long")
    counts, got = (x.value for x in lmscore.model(held, back, spark.sparkContext.broadcast(code)))
    own = lmscore.Texts(code, found, True)
    assert (counts == sum(events.sightings() for _, events, *_ in own.groups(texts))).all()
    ends = [(len(x), lmscore.score(x, own, lmscore.Cells(counts, True), lmscore.Mixer(), True)[1]) for x in [[x] for x in texts[:7]] + [texts[7:]]]
    refined = sum(k * m.refined for k, m in ends) / 9
    refined *= lmscore.APM_WEIGHT / np.maximum(refined.sum(axis=-1, keepdims=True), lmscore.APM_WEIGHT)
    assert np.allclose(got.weights, sum(k * m.weights for k, m in ends) / 9, atol=1e-6) and np.allclose(got.refined, refined, atol=1e-6)


def test_cells_are_summed_over_blocks(spark, monkeypatch):
    import zlib as z

    import pandas as pd

    monkeypatch.setattr(lmscore, "FAN", 3)
    rng = np.random.default_rng(1)
    data = [rng.integers(0, 9, 64) for _ in range(20)]
    rows = pd.DataFrame({"part": range(10), "slice": 0, "data": [z.compress(x.tobytes()) for x in data[:10]]})
    both = pd.concat([rows, rows.assign(slice=1, data=[z.compress(x.tobytes()) for x in data[10:]])])
    got = {r.slice: np.frombuffer(z.decompress(bytes(r.data)), np.int64) for r in lmscore._summed(spark.createDataFrame(both, "part int, slice int, data binary")).collect()}
    assert (got[0] == sum(data[:10])).all() and (got[1] == sum(data[10:])).all()


def test_learning_pays(spark):
    text = "the cat sat on the mat and the dog sat on the log "
    docs = spark.createDataFrame([(i, text * (1 + i % 3)) for i in range(20)], "doc_id long, text string")
    from pyspark.sql import functions as F

    taught = lmscore.score_documents(docs, F.col("doc_id") > 3).where("doc_id = 0").first()
    blank = lmscore.score_documents(docs, F.lit(False)).where("doc_id = 0").first()
    assert taught.bits_per_byte < 2 < blank.bits_per_byte < 9


def test_forward_sums_all_segmentations():
    import public_tokenizers

    voc = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = np.random.default_rng(1).random((voc.size, 2)) / voc.size
    plain = {model.id_to_piece(i): i for i in range(voc.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}

    def total(x):
        return 1.0 if not x else sum(table[plain[x[:k]]] * total(x[k:]) for k in range(1, len(x) + 1) if x[:k] in plain)

    for word in ("haus", "thee", "xyz"):
        assert np.allclose(langid.forward([word], table, voc)[0], np.log(total("▁" + word)))
    uses = langid.expected(["haus"], table, voc, np.ones((1, 2)))
    lengths = np.array([len(model.id_to_piece(i)) for i in range(voc.size)])
    assert np.allclose((uses * lengths[:, None]).sum(axis=0), 5)


def test_words_of_any_length_and_unknown_characters():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    voc, model = langid.vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    table = np.random.default_rng(1).random((voc.size, 3)) / voc.size
    plain = {model.id_to_piece(i): i for i in range(voc.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}

    def brute(word):
        """Log of the sum over segmentations, with exact integers: each weight is a multiple of 2 ** -200."""
        from fractions import Fraction

        x, out = "▁" + word, []
        for lang in range(3):
            way = [Fraction(1)] + [Fraction(0)] * len(x)
            for end in range(1, len(x) + 1):
                for start in range(end):
                    if x[start:end] in plain:
                        way[end] += way[start] * Fraction(table[plain[x[start:end]], lang])
                    elif end == start + 1:
                        weight = Fraction(1)
                        for b in x[start].encode():
                            weight *= Fraction(table[voc.bytes[b], lang])
                        way[end] += way[start] * weight
            out.append(math.log(way[-1].numerator) - math.log(way[-1].denominator))
        return out

    odd = ["donaudampfschifffahrtsgesellschaftskapitän"[:40], "\u0f40\u0f41\u0f42\u0f44\u0f45\u0f46\u0f47\u0f49" * 3, "x\u0f40y", "ab" * 30]
    got = langid.forward([*odd, "haus"], table, voc)
    assert np.allclose(got[:4], [brute(x) for x in odd]) and np.isfinite(got).all()
    uses = langid.expected(odd[1:2], table, voc, np.ones((1, 3)))
    assert np.allclose(uses.sum(axis=0), 1 + sum(1 if c in plain else 3 for c in odd[1]))  # bytes of characters that are no piece, and the start mark
    one, both = (langid.expected(x, table, voc, np.ones((len(x), 3))) for x in (["haus"], ["haus", odd[0]]))
    apart = langid.expected([odd[0]], table, voc, np.ones((1, 3)))
    assert np.allclose(one + apart, both)


def test_predictions_and_rounds(spark, docs):
    """Predictions are the largest sums of forward; each round of learning raises the likelihood."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    voc, learned = langid.vocabulary(path), docs.where("lang IS NOT NULL AND doc_id < 40")
    held, likelihood = [(r.text, r.lang) for r in learned.collect() if r.text], []
    for rounds in (1, 2, 3):
        model = langid.train(learned, path, rounds)
        logs = [langid.forward((t.split() or [""]), model.table, voc).sum(axis=0)[model.langs.index(x)] if t.split() else 0 for t, x in held]
        likelihood.append(sum(logs))
    assert likelihood[0] < likelihood[1] <= likelihood[2] + 1e-6 * abs(likelihood[2])
    got = {r.doc_id: r for r in langid.predict(docs, model, path).collect()}
    for r in docs.collect():
        if r.text and any(map(str.isalpha, r.text)):
            total = langid.forward(r.text.split(), model.table, voc).sum(axis=0)
            share = np.exp(total - total.max())
            assert got[r.doc_id].lang_pred == model.langs[int(total.argmax())] and abs(got[r.doc_id].score - 1 / share.sum()) < 1e-9


def test_languages_in_blocks(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = {"de": "der hund und das haus", "en": "the dog and the house", "es": "el perro y la casa", "fr": "le chien et la maison", "it": "il cane e la casa"}
    docs = [(i, " ".join([t] * (1 + i % 3) + [f"x{i}é"]), lang) for i, (lang, t) in enumerate(list(texts.items()) * 8)] + [(90, None, "en"), (91, "12 34", "fr"), (None, "the dog", None), (3, "la casa", "it"), (92, " \x1c\u2003the\x85house ", "en")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    whole = sorted(langid.identify(docs, docs, path).collect(), key=str)
    for most in (1, 2, 4, 5):
        parts = sorted(langid.identify(docs, docs, path, most=most).collect(), key=str)
        assert [(r.doc_id, r.lang_pred) for r in parts] == [(r.doc_id, r.lang_pred) for r in whole]
        assert np.allclose([r.score for r in parts], [r.score for r in whole], atol=1e-9)
    found = {(r.doc_id, r.lang_pred) for r in whole}
    assert {(90, "und"), (91, "und"), (None, "en"), (92, "en")} <= found and all((i, lang) in found for i, lang in enumerate(list(texts) * 8))
    none = langid.identify(docs, docs.where("lang = 'xx'"), path).collect()
    assert len(none) == docs.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in none)


def test_languages(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op3_")}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        letter = any(map(str.isalpha, text or ""))
        assert (got[i].lang_pred == "und") != letter and 0 <= got[i].score <= 1


def test_lines(spark, folder, rows):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    n = collections.Counter()
    for _, t, *_ in rows:
        n.update({key(x) for x in (t or "").split("\n")})
    got = {r.doc_id: r for r in run(spark, folder, "op4_")}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_first_lines_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb\nA "), (0, "b"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r.n_dropped for r in linededup.bitmaps(docs, min_docs=1).collect()}
    assert got == {1: 2}


def test_texts_that_share_an_id_have_their_own_bitmaps(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "d\nA"), (1, "d\nA"), (2, "a\n\nd"), (None, "a"), (3, None)], "doc_id int, text string")
    maps = linededup.bitmaps(docs, min_docs=2, keep_first=False)
    found = docs.withColumn("copy", F.xxhash64("text")).join(maps, ["doc_id", "copy"], "left")
    got = sorted((str(r.doc_id), r.kept) for r in found.select("doc_id", linededup.kept_text(F.col("text"), F.col("dropped")).alias("kept")).collect())
    assert got == [("1", ""), ("1", ""), ("1", "b\nc"), ("2", ""), ("3", ""), ("None", "a")]


def test_packing(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, total = collections.defaultdict(list), 0
    seqs = collections.defaultdict(list)
    for r in run(spark, folder, "op5_"):
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        assert sorted(got[i]) == [(k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) <= -(-total // 4096) + 1


def test_bounds_never_pass_best_fit():
    r = np.random.default_rng(3)
    for _ in range(50):
        lengths = r.integers(1, 100, r.integers(1, 60))
        bins = packing.best_fit(lengths, 100)
        assert np.bincount(bins, lengths).max() <= 100 and packing.lower_bound(lengths, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7


def test_exchange_between_partitions(spark, tmp_path):
    lengths = np.random.default_rng(2).integers(1, 4096, 5000)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "doc_id int, length long").write.parquet(f"{tmp_path}/items")
    out, certificates = packing.packed(spark.read.parquet(f"file://{tmp_path}/items"), per_part=200)
    out, certificates = out.toPandas(), certificates.toPandas()
    assert len(out) == 5000 and sorted(out.length) == sorted(lengths) and out.groupby("sequence_id").length.sum().max() <= 4096
    assert out.sequence_id.nunique() <= 1.01 * packing.lower_bound(lengths, 4096)
    assert (certificates.bins >= certificates.bound).all() and certificates["round"].nunique() > 1 and (certificates.bins - certificates.given).sum() == out.sequence_id.nunique()


def test_tokens_of_the_vocabulary_are_themselves():
    """What makes merging by lowest id the library's own encoding: each token, encoded alone, is that token."""
    import json

    import public_tokenizers
    from tokenizers.models import BPE

    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordIds(path)
    model, plain = words.found.model, json.load(open(path))["model"]
    inner = BPE(plain["vocab"], [tuple(x) for x in plain["merges"]])
    for token, i in plain["vocab"].items():
        own = model.tokenize(token.removesuffix("</w>")) if token.endswith("</w>") else inner.tokenize(token)
        assert [x.id for x in own] == [i], token
    assert all(plain["vocab"]["".join(x)] == 512 + i for i, x in enumerate(plain["merges"]))
    odd = ["it's we'LL don't’s «ça» ½ 12 ª", "İstanbul", "a\x7fb", "\x85 x\x0by", "Ǆ ß ÿŸ—…€", "a" * 500 + " " + "!?" * 90, "<|endoftext|> x", "e\u0301"]
    assert words.of(odd) == [np.array(words.found.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]


def test_exact(spark, folder, rows):
    same = collections.defaultdict(list)
    for i, t, *_ in rows:
        same[low(t)].append(i)
    got = {r.doc_id: r for r in run(spark, folder, "op6_")}
    for t, ids in same.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_digests_that_clash_are_not_trusted(spark, folder, docs, monkeypatch):
    answer = lambda: sorted(map(tuple, exactdedup.groups(docs.select("doc_id", "text")).collect()))
    want = answer()
    monkeypatch.setattr(exactdedup, "MOST_CLASHES", -1)  # over it: bytes instead of digests
    assert exactdedup.clashes(docs) is None and answer() == want
    made = spark.createDataFrame([(1, "same", b"x"), (2, "same", b"y"), (3, "same", b"x")], "doc_id long, text_sha256 string, recipe binary")
    monkeypatch.setattr(exactdedup, "recipes", lambda _: made)  # two recipes under the digest of one text
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exactdedup.groups(docs).collect()) == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)", "date"])
def test_ids_of_other_types_are_scored(spark, kind):
    docs = spark.range(4).selectExpr(f"CAST({'date_add(DATE\'2024-01-01\', CAST(id AS INT))' if kind == 'date' else 'id'} AS {kind}) AS doc_id", "concat('words of ', id) AS text")
    big = spark.createDataFrame([(2**53 + 1, "a"), (None, "b")], "doc_id long, text string")
    from pyspark.sql import functions as F

    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    assert ids(lmscore.score_documents(docs, F.lit(True))) == ids(docs) and ids(lmscore.score_documents(big, F.lit(True))) == ids(big)


def test_chunks_follow_content():
    data = np.random.default_rng(0).integers(97, 123, 60_000).astype(np.uint8).tobytes()
    split = lambda x: [x[a:b] for a, b in zip([0, *exactdedup.cuts(x)], exactdedup.cuts(x), strict=False)]
    assert b"".join(split(data)) == data and len(set(split(data)) & set(split(b"new start" + data))) > len(split(data)) - 4


def test_mix(spark, folder, rows):
    got = run(spark, folder, "op7_")
    source = {i: s for i, _, _, s, _ in rows}
    size = {i: len(words(t)) for i, t, *_ in rows}
    order = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in order}
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(size.values()))
    while True:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and math.isclose(r.target, target[source[r.doc_id]]) and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 5 for s in order) and got and sorted(got) == sorted(run(spark, folder, "op7_"))


def test_newton_meets_constraints_that_interact(spark):
    """Source and language targets at once: both margins are met, by rates that are a product of one factor each."""
    sizes = [[40, 10, 0], [5, 30, 20], [7, 9, 50]]
    sources, langs = {"a": 90, "b": 60, None: 21}, {"x": 70, "y": 60, "z": 41}
    rows = [(s, l, sizes[i][j], float(sources[s]), float(langs[l])) for i, s in enumerate(sources) for j, l in enumerate(langs) if sizes[i][j]]
    cells = spark.createDataFrame(rows, "source string, lang string, size long, source_target double, lang_target double")
    got = {(r.source, r.lang): r for r in mixing.balanced(cells, ["source", "lang"]).collect()}
    for name, want in (("source", sources), ("lang", langs)):
        for value, target in want.items():
            assert abs(sum(r["size"] * r.rate for r in got.values() if r[name] == value) - target) < 1e-6 * target
    rate = {k: r.rate for k, r in got.items()}
    assert abs(rate["b", "x"] * rate[None, "y"] / (rate["b", "y"] * rate[None, "x"]) - 1) < 1e-9
    assert abs(rate["b", "y"] * rate[None, "z"] / (rate["b", "z"] * rate[None, "y"]) - 1) < 1e-9
    one = mixing.balanced(cells.select("source", "lang", "size", "source_target"), ["source"]).collect()
    assert all(abs(sum(r["size"] * r.rate for r in one if r.source == s) - t) < 1e-6 * t for s, t in sources.items())


def test_token_counts(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in run(spark, folder, "op8_")}
    for i, t, *_ in rows:
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert tokens.SAFE and isinstance(tokens.PATTERN, str)


def test_urls(spark, folder):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in run(spark, folder, "op9_")}
    assert got[0] == ("a.example.com", "/en/1", "com/en/", "block") and got[3] == ("b.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1][:3] == got[2][:3] == ("", "", None) and got[4] == ("example.net", "/de/8", "example.net/de/8", "block")


def test_reputation_shrinks(spark):
    rows = [("a.x.com", 1)] * 40 + [("b.x.com", 1)] + [("c.y.com", 0)] * 40 + [("d.z.org", 0)] * 9
    got = {r.host: r for r in hosts.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.x.com"].bound > got["b.x.com"].bound and 0.5 < got["b.x.com"].rate < 1 and got["c.y.com"].rate < 0.2


def test_hosts_without_outcomes_are_judged_by_domain_and_suffix(spark):
    from pyspark.sql import functions as F

    rows = [("a.x.com", 1)] * 40 + [("b.x.com", 1)] * 40 + [("c.y.org", 0)] * 40 + [("d.z.org", 0)] * 40 + [(h, None) for h in ("new.x.com", "new.w.com", "new.y.org", "new.v.net")]
    got = {r.host: r for r in hosts.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    known = {r.host: r for r in hosts.reputations(spark.createDataFrame([x for x in rows if x[1] is not None], "host string, bad int")).collect()}
    assert len(got) == 8 and all(got[h] == known[h] for h in known)
    assert got["b.x.com"].rate > got["new.x.com"].rate > got["new.w.com"].rate > got["new.v.net"].rate == 0.5 > got["new.y.org"].rate
    urls = [(0, "http://new.x.com/"), (1, "http://new.y.org/"), (2, "http://new.v.net/")]
    labels = spark.createDataFrame([(f"http://{h}/", b) for h, b in rows if b is not None], "url string, bad int")
    pages = spark.createDataFrame(urls, "page_id long, url string")
    assert {r.page_id: r.verdict for r in hosts.judge(pages, (), labels).collect()} == {0: "block", 1: "allow", 2: "allow"}
    assert hosts.judge(pages, (), labels.where(F.lit(False)), limit=0.0).where("verdict = 'block'").count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_links(docs, rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(low(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_components(docs, width, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 140)} == {100}


def test_pipeline(spark, folder, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        docs = docs.cache()
        assert docs.columns == before.columns, name
    assert corpus_pipeline.run(spark, folder).count() >= docs.count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, null and empty texts, and columns with the names of a stage's own."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    r = random.Random(1)
    prose = [" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(80)) for _ in range(6)]
    rows = [(1, prose[0]), (1, prose[0]), (2, prose[0].upper()), (None, prose[1]), (None, prose[1]), (3, prose[2]), (3, prose[3]), (None, prose[2]), (4, None), (5, ""), (6, prose[4]), (7, prose[4] + " more")]
    made = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("_copies", "_copy", "row", "id", "sha", "times", "of", "kept", "size", "component_id")])
    made.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    stage = dict(corpus_pipeline.STAGES)
    once = stage["exact_dedup"](spark, docs, "")
    key = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    want = [(2, prose[0].upper()), (None, prose[1]), (3, prose[2]), (3, prose[3]), (5, ""), (6, prose[4]), (7, prose[4] + " more")]
    assert once.columns == docs.columns and key(once) == sorted(want, key=str)
    apart = stage["near_dedup"](spark, once, "")
    assert apart.columns == docs.columns and key(apart) == sorted([x for x in want if x[0] != 7], key=str)
    mixed, size = stage["source_mix"](spark, apart, ""), lambda df: sum(len(words(x.text)) for x in df.collect())
    assert mixed.columns == docs.columns and size(mixed) >= 0.9 * size(apart) and {x[0] for x in key(mixed)} <= {x[0] for x in key(apart)}
    assert stage["quality_rules"](spark, docs, "").columns == docs.columns
    assert stage["pack_sequences"](spark, mixed, "").count() == mixed.count()


def test_of_repeated_rows_the_same_one_stays(spark):
    import corpus_pipeline

    rows = [(1, "text", "b", 2), (1, "text", "a", 3), (1, "text", "c", 1)]
    for turn in range(3):
        docs = spark.createDataFrame(rows[turn:] + rows[:turn], "doc_id long, text string, source string, n long").repartition(turn + 1)
        assert [tuple(r) for r in corpus_pipeline.exact_dedup(spark, docs, "").collect()] == [(1, "text", "a", 3)]


def test_tables_on_the_way_go(spark):
    from zonecast.llm import common

    before = set(common._written)
    out = common.settle(lambda: common.keep(spark.range(5), "first").where("id > 2"), "second")
    assert out.count() == 2 and len(set(common._written) - before) == 1
    common.drop(out)
    assert set(common._written) == before


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in entry.queries().items():
        if name.startswith("op") or name == "pipeline":
            assert query(spark, f"file://{tmp_path}").count() == 0, name
    assert mixing.ROUNDS
