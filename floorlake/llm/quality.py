"""Quality rules: base counts and divergence from each language's own histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorlake.llm.common import NOT_SPACE, SPACE, let, set_aside, words
from floorlake.staging import broadcast_if_small, staged

# Frequent function words, by language.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "as", "on", "be", "at", "by"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "que", "une", "du", "dans", "qui", "par", "pour", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
# Character classes, in the order in which they are taken out of a text.
CLASSES = [("lower", r"\p{Ll}+"), ("space", r"[\x20\x09-\x0D]+"), ("upper", r"\p{Lu}+"), ("stop", r"[.,]+"), ("digit", r"\p{Nd}+"), ("letter", r"\p{L}+"), ("mark", r"[!?;:\x27\x22()\-]+")]
N_CLASSES = len(CLASSES) + 1
N_COMMON = 17

#: Farther than this from the language's reference, in Jensen-Shannon distance, and a text is rejected.
MAX_CHAR_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.28
#: Shorter texts say too little about their distribution; they aren't judged by it.
MIN_CHARS = 200
MIN_WORDS = 100


def n_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``w``, an array of words.

    Sorts (64-bit hash of the window, place) and compares neighbours, so the work is n log n
    however long the text.
    """

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, zero, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def counted(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, lambda s: covered(places(s))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, counted)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def class_counts(text: Column) -> Column:
    """Code points of each character class, the rest last."""
    counts, rest = [], text
    for _, pattern in CLASSES:
        less = F.regexp_replace(rest, pattern, "")
        counts.append(F.length(rest) - F.length(less))
        rest = less
    return F.array(*counts, F.length(rest)).cast("array<long>")


def common_counts(w: Column, lang: Column) -> Column:
    """Counts of the language's common words, the other words last; an unknown language has others only."""
    every = sorted({x for v in COMMON.values() for x in v})
    none = F.array_repeat(F.lit("").cast("string"), N_COMMON - 1)
    listed = F.coalesce(*[F.when(lang == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()], none)

    def binned(hits: Column) -> Column:
        own = F.transform(listed, lambda c: F.size(F.filter(hits, lambda h: h == c)).cast("long"))
        return let(own, lambda o: F.array_append(o, F.size(w).cast("long") - F.aggregate(o, F.lit(0).cast("long"), lambda s, x: s + x)))

    return let(F.transform(F.filter(w, lambda x: F.lower(x).isin(every)), F.lower), binned)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two count arrays; 0 if either is empty of counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        term = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
        return (term(x) + term(y)) / 2

    def distance(t: Column) -> Column:
        parts = F.zip_with(p, q, lambda x, y: part(x.cast("double") / t["p"], y.cast("double") / t["q"]))
        return F.when((t["p"] > 0) & (t["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))).otherwise(F.lit(0.0))

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), distance)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with the base counts and both histograms, one pass over the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(
        *keep,
        F.coalesce("lang", F.lit("")).alias("__lang"),
        let(
            words(F.col("text")),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"), common_counts(w, F.col("lang")).alias("common")),
        ).alias("__w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("__word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("__n_symbols"),
        n_dup_lines(text).alias("__n_dup_lines"),
        class_counts(text).alias("__classes"),
    )
    return measured


def references(feats: DataFrame) -> DataFrame:
    """Histograms of each language: sums over all its documents, in one row a language."""
    sums = lambda c, n: F.array(*[F.sum(F.get(F.col(c), F.lit(i))) for i in range(n)])
    flat = feats.select("__lang", "__classes", F.col("__w.common").alias("__common"))
    return flat.groupBy("__lang").agg(sums("__classes", N_CLASSES).alias("__ref_classes"), sums("__common", N_COMMON).alias("__ref_common"))


def measured_quality(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed and ``__kept``.

    The features are staged once in the shared folder: the references need all documents first.
    """
    feats = staged(features(docs, keep), "quality")
    languages = broadcast_if_small(staged(references(feats), "languages"))  # a row a language, not two shuffles by it
    judged = feats.join(languages, "__lang", "left")
    n_chars = F.aggregate("__classes", F.lit(0).cast("long"), lambda s, x: s + x)
    n, repeats = F.col("__w.n_words"), F.col("__w.n_repeat_words")
    base_failed = (n < 50) | (100 * repeats > 50 * n)
    scored = judged.select(
        *keep,
        n.alias("__n_words"),
        "__word_chars",
        "__n_symbols",
        "__n_dup_lines",
        repeats.alias("__n_repeat_words"),
        base_failed.alias("__base_failed"),
        F.when(n_chars >= MIN_CHARS, js_distance(F.col("__classes"), F.col("__ref_classes"))).otherwise(F.lit(0.0)).alias("__char_distance"),
        F.when(n >= MIN_WORDS, js_distance(F.col("__w.common"), F.col("__ref_common"))).otherwise(F.lit(0.0)).alias("__word_distance"),
    )
    far = (F.col("__char_distance") > MAX_CHAR_DISTANCE) | (F.col("__word_distance") > MAX_WORD_DISTANCE)
    return scored.withColumn("__kept", ~F.col("__base_failed") & ~far)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; a row for each row of ``docs``.

    A null text counts as an empty one and fails the base rule. A null or unknown language is
    compared with the histograms of its like and has no common words. Repeated rows are judged
    alike, each with a row; an empty table gives no rows; extra columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return measured_quality(docs, ["doc_id"]).select("doc_id", *[F.col(f"__{x}").alias(x) for x in names])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they were."""
    docs, named_back = set_aside(docs)
    return named_back(measured_quality(docs, docs.columns).filter("__kept").select(*docs.columns))
