"""Quality rules by distribution divergence.

Every document gets two histograms: its characters by class, and its common words. Each is compared, by
Jensen-Shannon distance (base 2), with the reference of the document's language. References are sums over all other
documents of the language: the sums over all, one row a language, less the document's own counts. Texts under the minimum lengths are not judged by a histogram, because short
samples are far from any reference by chance.

Everything is a DataFrame expression over one row; the only shuffle carries the reference sums, one row a
language and task. Arrays of a row are the row's own words, so memory is bounded by the longest text.

Null and empty texts have no words: all counts are 0, the base rule fails, and they are not kept. A text in none
of the listed languages is compared with the sums over all such texts, by characters only. An empty table gives
no rows. Repeated rows are judged alike. Extra columns of the input are passed on; those named like a result
give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep

#: The commonest function words of each language, most frequent first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was"],
    "de": ["der", "die", "und", "in", "den", "das", "von", "zu", "mit", "ist", "des", "sich"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}

#: Character classes, none of which overlap: name and the characters it counts. What no class counts falls to a last one.
CLASSES = {
    "lower": r"\\p{Ll}",
    "upper": r"\\p{Lu}",
    "digit": r"\\p{Nd}",
    "space": r"\\x20\\x09-\\x0D",
    "stop": r".,;:?\'\"()\\-",
    "bang": r"!",
    "symbol": r"#*$%&|<>",
}


@dataclass(frozen=True)
class QualityRules:
    """Limits. Distances run from 0 (same) to 1 (nothing in common)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_chars_judged: int = 200
    min_words_judged: int = 100
    max_class_distance: float = 0.25
    max_word_distance: float = 0.235
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


_F = "_zc_quality"


def _features(rules: QualityRules) -> list[tuple[str, str]]:
    """Columns of the histograms, in the order they build on each other."""
    sets = {lang: ", ".join(f"'{w}'" for w in words) for lang, words in rules.common_words.items()}
    every = ", ".join(f"'{w}'" for w in sorted({w for words in rules.common_words.values() for w in words}))
    # each class is taken out of what the classes before it left, so only the first goes over the whole text
    left = ["t", *(f"left_{name}" for name in CLASSES)]
    taken = [(own, f"regexp_replace({before}, '[{chars}]+', '')") for before, own, chars in zip(left, left[1:], CLASSES.values(), strict=False)]
    counts = ", ".join(f"length({before}) - length({own})" for before, own in zip(left, left[1:], strict=False))
    longest = max(len(w) for words in rules.common_words.values() for w in words)
    hits = ", ".join(f"size(filter(common, w -> w IN ({words})))" for words in sets.values())
    langs = ", ".join(f"'{lang}'" for lang in sets)
    lists = ", ".join(f"array({words})" for words in sets.values())
    return [
        ("words", r"array_remove(split(t, '[\\x20\\x09-\\x0D]+'), '')"),
        ("common", f"filter(transform(filter(words, w -> length(w) <= {longest}), w -> translate(w, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')), w -> w IN ({every}))"),
        *taken,
        ("seen", f"array({counts})"),
        ("hits", f"array({hits})"),
        ("at", "CASE WHEN array_max(hits) > 0 THEN array_position(hits, array_max(hits)) ELSE 0L END"),
        ("language", f"CASE WHEN at > 0 THEN element_at(array({langs}), CAST(at AS INT)) ELSE '' END"),
        ("list", f"CASE WHEN at > 0 THEN element_at(array({lists}), CAST(at AS INT)) ELSE array('') END"),
        ("class_counts", "concat(seen, array(length(t) - aggregate(seen, 0, (a, x) -> a + x)))"),
        ("word_counts", "transform(list, w -> size(common) - size(array_remove(common, w)))"),
        ("word_counts", "concat(word_counts, array(size(words) - aggregate(word_counts, 0, (a, x) -> a + x)))"),
    ]


#: The counts of the base rule. windows: hashes of three words each; dup: those found elsewhere in the text.
_BASE = [
    ("windows", "CASE WHEN size(words) < 3 THEN array() ELSE transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))) END"),
    ("ordered", "CASE WHEN size(array_distinct(windows)) = size(windows) THEN array() ELSE sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END"),
    ("repeats", "sort_array(transform(filter(ordered, (s, k) -> coalesce(get(ordered, k - 1).h = s.h, false) OR coalesce(get(ordered, k + 1).h = s.h, false)), s -> s.i))"),
    ("n_words", "CAST(size(words) AS BIGINT)"),
    ("word_chars", "CAST(length(t) - (length(left_digit) - length(left_space)) AS BIGINT)"),
    ("n_symbols", "CAST(length(left_bang) - length(left_symbol) AS BIGINT)"),
    ("lines", r"filter(split(t, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"),
    ("n_dup_lines", "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)"),
    ("n_repeat_words", "aggregate(transform(repeats, (p, k) -> least(3, coalesce(get(repeats, k + 1) - p, 3))), 0L, (a, x) -> a + x)"),
]


def _with(df: DataFrame, columns: list[tuple[str, str]], names: set[str]) -> DataFrame:
    """Adds expressions one projection each, so that what several later ones read is computed once."""
    for name, sql in columns:
        names.add(name)
        for known in sorted(names | {"t"}, key=len, reverse=True):
            sql = _bound(sql, known)
        df = df.withColumn(f"{_F}_{name}", F.expr(sql))
    return df


def _bound(sql: str, name: str) -> str:
    """The column behind a short name, outside quotes and field names."""
    import re

    parts = re.split(r"('(?:\\.|[^'\\])*')", sql)
    return "".join(p if p.startswith("'") else re.sub(rf"(?<![\w.]){name}(?!\w)(?! ->)(?!\()", f"{_F}_{name}", p) for p in parts)


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms given as arrays of counts; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda x, n: x.cast("double") / F.when(n > 0, n)
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    pairs = F.zip_with(counts, reference, lambda x, y: F.struct(share(x, total(counts)).alias("p"), share(y, total(reference)).alias("q")))
    sum_ = F.aggregate(pairs, F.lit(0.0), lambda s, z: s + part(z["p"], z["q"]) / 2 + part(z["q"], z["p"]) / 2)
    return F.sqrt(F.greatest(F.coalesce(sum_, F.lit(0.0)), F.lit(0.0)))


_RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "language"]
_JUDGED = ["class_distance", "word_distance", "base_failed", "kept"]
_COUNTS = [f"{_F}_{x}" for x in ("class_counts", "word_counts", "chars")]


def measured(docs: DataFrame, rules: QualityRules = QualityRules(), carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (null: all) with the counts of the base rule, the language and the histograms."""
    passed = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {*_RESULTS, *_JUDGED}]
    df = docs.select(*[F.col(f"`{c}`") for c in passed], F.coalesce(docs["text"], F.lit("")).alias(f"{_F}_t"))
    names: set[str] = set()
    df = _with(_with(df, _features(rules), names), _BASE, names)
    c = lambda name: F.col(f"{_F}_{name}")
    return df.select(*[F.col(f"`{x}`") for x in passed], *[c(x).alias(x) for x in _RESULTS], c("class_counts"), c("word_counts"), F.length(c("t")).alias(f"{_F}_chars"))


def references(rows: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row a language: language, class_reference, word_reference (summed counts over all measured rows)."""
    n_class, n_word = len(CLASSES) + 1, max(map(len, rules.common_words.values())) + 1
    item = lambda name, i: F.sum(F.coalesce(F.get(f"{_F}_{name}", F.lit(i)), F.lit(0)).cast("long"))
    return (
        rows.groupBy("language")
        .agg(*[item("class_counts", i).alias(f"c{i}") for i in range(n_class)], *[item("word_counts", i).alias(f"w{i}") for i in range(n_word)])
        .select("language", F.array(*[f"c{i}" for i in range(n_class)]).alias("class_reference"), F.array(*[f"w{i}" for i in range(n_word)]).alias("word_reference"))
    )


def judge(rows: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Measured rows with class_distance, word_distance (null: not judged), base_failed, kept, and without the histograms."""
    passed = [x for x in rows.columns if x not in {*_RESULTS, *_COUNTS}]
    c = lambda name: F.col(f"{_F}_{name}")
    refs = references(rows, rules).select(F.col("language").alias(f"{_F}_ref"), "class_reference", "word_reference")
    refs = refs.withColumnsRenamed({x: f"{_F}_{x}" for x in ("class_reference", "word_reference")})
    # one row a listed language, so the size of what is broadcast is fixed by the rules
    df = rows.join(F.broadcast(refs), F.col("language") == c("ref"), "left")
    long_words = (F.col("n_words") >= rules.min_words_judged) & (F.col("language") != "")
    width = F.size(c("word_counts"))
    others = lambda all_, own: F.zip_with(all_, own, lambda a, x: a - x)
    df = df.withColumn("class_distance", F.when(c("chars") >= rules.min_chars_judged, distance(c("class_counts"), others(c("class_reference"), c("class_counts")))))
    df = df.withColumn("word_distance", F.when(long_words, distance(c("word_counts"), others(F.slice(c("word_reference"), F.lit(1), width), c("word_counts")))))
    df = df.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    far = F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > rules.max_word_distance, F.lit(False))
    df = df.withColumn("kept", ~F.col("base_failed") & ~far)
    return df.select(*[F.col(f"`{x}`") for x in passed], *_RESULTS, *_JUDGED)


def kept(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that pass, as they are.

    The verdict passes through explode, because a plain filter would be pushed below the projections that build it,
    and what they share would be computed anew at every use.
    """
    judged = judge(measured(docs.select("text", F.struct("*").alias(f"{_F}_row")), rules, [f"{_F}_row"]), rules)
    passed = judged.select(f"{_F}_row", F.explode(F.array("kept")).alias(f"{_F}_kept")).where(f"{_F}_kept")
    return passed.select(f"{_F}_row.*")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the counts are written, so that texts are read once
    rows = keep(measured(documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"]), "quality")
    return judge(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
