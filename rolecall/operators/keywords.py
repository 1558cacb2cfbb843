"""Many search terms at once.

Every text is read once, where it is. Plain terms are found by an index of their first eight bytes, all in one pass
however many there are; regular expressions, and plain terms where there are only some dozens, are looked for one by
one, as in ``scoring``. Only rows whose key repeats are gathered by key, without their texts.

Terms that are no plain text (regular expressions, terms with other letters than ASCII, with spaces at an
end or next to each other, or of over ``MOST_WORDS`` words) count as regular expressions; beside more than ``FEW``
terms there may be ``MOST_PATTERNS`` of them.

A table of more than ``MOST_SCANNED`` plain terms stays distributed (an inverted look-up). A first reading gathers the
distinct words of all texts (runs without a space); terms are found in those by an equi-join on three-letter grams. The
second reading joins each text's words with the words that hold a term. A term of several words is looked for by its
longest one, and where that is met it is compared with the words around.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow_text import found_places, held_terms, named_scores, scannable
from ..functions.patterns import fold, search_folded
from ..sources.storage import materialize
from .filters import any_of, never_null

TEXTS = ("title", "description")
GRAM = 3
MOST_PATTERNS = 500
MOST_WORDS = 6
MOST_SCANNED = 1 << 17  # plain terms that are sent to every task
FEW = 100  # terms for which one scan of the texts each costs less
# A regular expression that is a plain ASCII text: no syntax, or escaped.
_PLAIN = r"^(?:[\x00-\x7F&&[^\\.^$*+?{}\[\]|()]]|\\[\x00-\x7F&&[^A-Za-z0-9]])+$"


def term_table(spark: SparkSession, scored_terms: Mapping[int, Sequence[str]]) -> DataFrame:
    """(place, term, weight) of terms listed by weight."""
    rows = [(term, weight) for weight, listed in scored_terms.items() for term in listed]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place long, term string, weight int")


def _plain() -> Column:
    """A plain term's text, folded."""
    return F.lower(F.regexp_replace("term", r"\\(.)", "$1"))


def _anchors(terms: DataFrame) -> DataFrame:
    """(place, n, k, piece, gram, phrase): of each plain term its longest word, the kth of n."""
    split = terms.select("place", _plain().alias("phrase"), F.split(_plain(), " ").alias("pieces"))
    sizes = F.transform("pieces", F.length)
    longest = split.withColumn("n", F.size("pieces")).withColumn("k", F.array_position(sizes, F.array_max(sizes)).cast("int") - 1)
    anchor = longest.withColumn("piece", F.get("pieces", F.col("k"))).drop("pieces")
    return anchor.withColumn("gram", F.substring("piece", 1, GRAM))


def _words(rows: DataFrame, columns: Sequence[str]) -> Column:
    """The words of a row's folded texts, with an empty word between texts."""
    parts = []
    for c in columns:
        parts += [F.split(F.coalesce(fold(F.col(c)), F.lit("")), " ", -1), F.array(F.lit(""))]
    return F.concat(*parts)


def _is_plain() -> Column:
    inner = _plain()
    single_spaces = ~inner.startswith(" ") & ~inner.endswith(" ") & ~inner.contains("  ")
    return F.col("term").rlike(_PLAIN) & single_spaces & (F.size(F.split(inner, " ")) <= MOST_WORDS)


def holding_words(rows: DataFrame, anchors: DataFrame, columns: Sequence[str] = TEXTS) -> DataFrame:
    """(word, place, phrase): the texts' distinct words that an anchor fits; phrase is null for single words."""
    sizes = [r[0] for r in anchors.select(F.length("gram")).distinct().collect()]  # 1 to GRAM
    words = rows.select(F.explode(F.array_distinct(_words(rows, columns))).alias("word")).distinct()
    grams = F.array_distinct(F.concat(*map(_grams, sizes))) if sizes else F.array().cast("array<string>")
    word, piece = F.col("word"), F.col("piece")
    first, last = F.col("k") == 0, F.col("k") == F.col("n") - 1
    fits = (
        F.when(F.col("n") == 1, word.contains(piece)).when(first, word.endswith(piece))
        .when(last, word.startswith(piece)).otherwise(word == piece))
    return words.select("word", F.explode(grams).alias("gram")).join(anchors, "gram").where(fits).select(
        "word", "place", F.when(F.col("n") > 1, F.col("phrase")).alias("phrase"))


def _grams(size: int) -> Column:
    length = F.length("word")
    starts = F.sequence(F.lit(1), F.greatest(length - (size - 1), F.lit(1)))
    return F.when(length >= size, F.transform(starts, lambda i: F.col("word").substr(i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def _plain_hits(rows: DataFrame, terms: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    anchors = materialize(_anchors(terms), "anchors")
    held = materialize(holding_words(rows, anchors, columns), "words")
    longest = anchors.agg(F.max("n")).first()[0] or 1
    if longest == 1:
        each = rows.select(key, F.explode(F.array_distinct(_words(rows, columns))).alias("word"))
        return each.join(held, "word").select(key, "place").distinct()
    # every word with the words around it that a phrase may need
    around = lambda i: F.array_join(F.slice("_words", F.greatest(i - (longest - 2), F.lit(1)), 2 * longest - 1), " ")
    placed = F.transform("_words", lambda w, i: F.struct(w.alias("word"), around(i).alias("around")))
    each = rows.select(key, _words(rows, columns).alias("_words")).select(key, F.inline(placed))
    met = each.join(held, "word").where(F.col("phrase").isNull() | F.col("around").contains(F.col("phrase")))
    return met.select(key, "place").distinct()


def _pattern_places(terms: Sequence, columns: Sequence[str]) -> Column:
    """Which of the terms any of the texts holds, each looked for on its own."""
    texts = [F.col(c) for c in columns]
    searches = [(r["place"], scannable(r["term"])) for r in terms]
    scanned = [(place, s) for place, s in searches if s is not None]
    left = [r["place"] for r, (_, s) in zip(terms, searches) if s is None]
    patterns = {r["place"]: r["term"] for r in terms}
    hits = [
        F.when(any_of(*(never_null(search_folded(fold(t), t, patterns[place])) for t in texts)), F.lit(place).cast("int"))
        for place in left
    ]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")
    return F.concat(found_places(texts, scanned), found) if scanned else found


def _with_places(rows: DataFrame, terms: DataFrame, key: str, columns: Sequence[str], few: int) -> tuple[DataFrame, list] | None:
    """(key, plain, patterns): indexes of the terms that each row's texts hold, and the terms in the order of their
    places; ``None`` if they are too many to be sent to every task."""
    terms = terms.where("term <> ''")
    listed = terms.limit(few + 1).collect()
    plain = []
    if len(listed) > few:
        patterns = terms.where(~_is_plain()).limit(MOST_PATTERNS + 1).collect()
        if len(patterns) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} terms are no plain texts")
        plain = terms.where(_is_plain()).withColumn("_phrase", _plain()).limit(MOST_SCANNED + 1).collect()
        if len(plain) > MOST_SCANNED:
            return None
        listed = patterns + plain
    listed = sorted(listed, key=lambda r: r["place"])
    phrases = {r["place"]: r["_phrase"] for r in plain}
    numbered = [{"place": i, "term": r["term"]} for i, r in enumerate(listed)]
    held = [(i, phrases[r["place"]]) for i, r in enumerate(listed) if r["place"] in phrases]
    none = F.array().cast("array<int>")
    found = held_terms([F.col(c) for c in columns], [p for _, p in held], [i for i, _ in held]) if held else none
    alone = [n for n, r in zip(numbered, listed) if r["place"] not in phrases]
    return rows.select(key, found.alias("plain"), _pattern_places(alone, columns).alias("patterns")), listed


def keyword_hits(rows: DataFrame, terms: DataFrame, key: str, columns: Sequence[str] = TEXTS, few: int = FEW) -> DataFrame:
    """(key, place): which terms occur in any of a row's texts, ignoring case.

    ``terms`` is (place, term); terms are regular expressions. ``key`` tells the rows apart and has no nulls.
    Up to ``few`` terms are looked for one by one.
    """
    terms = terms.where("term <> ''").select("place", "term")
    scanned = _with_places(rows, terms, key, columns, few)
    if scanned is None:
        return _joined_hits(rows, terms, key, columns)
    found, listed = scanned
    places = F.array(*(F.lit(r["place"]).cast("long") for r in listed)) if listed else F.array().cast("array<long>")
    hits = [found.select(key, F.explode(kind).alias("i")) for kind in ("plain", "patterns")]
    return hits[0].distinct().union(hits[1]).select(key, F.get(places, "i").alias("place"))


def _joined_hits(rows: DataFrame, terms: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    hits = _plain_hits(rows, terms.where(_is_plain()), key, columns)
    patterns = terms.where(~_is_plain()).collect()  # MOST_PATTERNS at most
    found = _pattern_places([{"place": i, "term": r["term"]} for i, r in enumerate(patterns)], columns)
    if not patterns:
        return hits
    places = F.array(*(F.lit(r["place"]).cast("long") for r in patterns))
    return hits.union(rows.select(key, F.explode(found).alias("i")).select(key, F.get(places, "i").alias("place")))


def keyword_scores(
    rows: DataFrame, terms: DataFrame, key: str, columns: Sequence[str] = TEXTS, few: int = FEW
) -> DataFrame:
    """(key, keyword_score, keywords) of every row: the sum of its terms' weights, and the terms in table order.

    ``terms`` is (place, term, weight); backslashes are left out of the names. Rows that repeat a key are scored
    together, rows without one are not scored.
    """
    scanned = _with_places(rows, terms, key, columns, few)
    if scanned is None:
        named = terms.select("place", F.replace("term", F.lit("\\"), F.lit("")).alias("name"), "weight")
        hits = _joined_hits(rows, terms.where("term <> ''").select("place", "term"), key, columns)
        found = hits.join(named, "place").groupBy(key).agg(
            F.sum("weight").cast("int").alias("keyword_score"),
            F.array_sort(F.collect_list(F.struct("place", "name"))).getField("name").alias("keywords"))
    else:
        found, listed = scanned
        unclear = rows.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1))
        several = bool(unclear.limit(1).count())
        if several:
            found = found.where(F.col(key).isNotNull()).groupBy(key).agg(
                F.array_distinct(F.flatten(F.collect_list("plain"))).alias("plain"),
                F.flatten(F.collect_list("patterns")).alias("patterns"))
        names, weights = [r["term"].replace("\\", "") for r in listed], [r["weight"] or 0 for r in listed]
        scored = named_scores(F.array_sort(F.concat("plain", "patterns")), names, weights)
        found = found.select(key, scored.alias("_s")).select(
            key, F.col("_s.score").alias("keyword_score"), F.col("_s.keywords").alias("keywords"))
        if not several:
            return found
    return rows.select(key).join(found, key, "left").select(
        key, F.coalesce("keyword_score", F.lit(0)).alias("keyword_score"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
