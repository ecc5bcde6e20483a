"""Benchmark passages in documents, found by winnowed fingerprints; DataFrame operations only.

Every ``K``-word gram of a text has a hash, and of each window of grams the least hash is the
window's fingerprint. Two equal windows have equal fingerprints at equal places, so a shared span
that is as long as a window cannot be missed, and neighbouring windows mostly share theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.llm.rules import _let
from authscope.session import cut_lineage

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = 10
K = 5
#: The low bits of a fingerprint hold its gram's place modulo 16; a window has fewer grams.
PLACES = 16
#: Rows of the benchmark's windows up to which they are sent to all tasks (some 200 bytes a row).
SENT = 100_000


def _inner(split: Column) -> Column:
    """The strings between breaks: all but an empty first and an empty last one."""

    def inner(s: Column) -> Column:
        first, last = (F.when(F.get(s, i) == "", 1).otherwise(0) for i in (F.lit(0), F.size(s) - 1))
        return F.slice(s, first + 1, F.greatest(F.size(s) - first - last, F.lit(0)))

    return _let(split, inner)


def words_of(text: Column) -> Column:
    """Words of a text, runs of ASCII letters and digits and other than ASCII characters, A to Z
    as a to z; a null text has none."""
    return _inner(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK))


def _grams(words: Column, k: int) -> Column:
    """Hashes of all ``k``-word grams, their low bits replaced by their place modulo ``PLACES``."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - (k - 1)),
        lambda i: F.xxhash64(F.slice(words, i, k)).bitwiseAND(F.lit(-PLACES)).bitwiseOR((i - 1) % PLACES),
    )


def _least(grams: Column, window: int) -> Column:
    """The least of every ``window`` grams: of two, of four and so on, then of two overlapping runs."""

    def of(values: Column, run: int) -> Column:
        if run == window:
            return values
        step = min(run, window - run)
        rest = F.size(values) - step
        both = F.zip_with(F.slice(values, 1, rest), F.slice(values, step + 1, rest), lambda x, y: F.least(x, y))
        return _let(both, lambda least: of(least, run + step))

    return of(grams, 1)


def _winnowed(grams: Column, window: int) -> Column:
    """Fingerprints by window start; null where the window before it has the same."""

    def fresh(found: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("long")), F.slice(found, 1, F.size(found) - 1))
        return F.zip_with(found, before, lambda x, y: F.when(y.isNull() | (x != y), x))

    return _let(_least(grams, window), fresh)


def _shape(length: int) -> tuple[int, int]:
    """Words in a gram and grams in a window, for spans of ``length`` words."""
    k = min(K, length)
    return k, length - k + 1


def _seeds(words: Column, lengths: list[int]) -> Column:
    """The fingerprints for each length of span, as (length, seeds)."""

    def of(length: int) -> Column:
        k, window = _shape(length)
        seeds = _let(_grams(words, k), lambda g: _winnowed(g, window))
        return F.when(F.size(words) >= length, F.struct(F.lit(length).alias("length"), seeds.alias("seeds")))

    return F.array(*[of(n) for n in lengths])


def _items(items: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """A row for each item text with words: (item, words, length), length the words in a window."""
    words = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("words"))
    return words.where(F.size("words") > 0).withColumn("length", F.least(F.lit(span), F.size("words"))).distinct()


def _windows(items: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each window of an item and each place of its least gram hash.

    Where equal grams tie for the least hash, each of their places is a row: a document's window
    may name any of them.
    """
    found = []
    for length in lengths:
        k, window = _shape(length)
        of = items.where(F.col("length") == length)
        of = of.select("item", "words", F.posexplode(F.sequence(F.lit(1), F.size("words") - (length - 1))).alias("p", "start"))
        of = of.select("item", F.slice("words", F.col("start"), length).alias("span"))
        grams = F.transform(
            F.sequence(F.lit(1), F.lit(window)),
            lambda j: F.xxhash64(F.slice(F.col("span"), j, k)).bitwiseAND(F.lit(-PLACES)),
        )
        of = of.select("item", "span", grams.alias("grams"))
        of = of.select("item", "span", F.array_min("grams").alias("hash"), F.posexplode("grams").alias("at", "gram"))
        found.append(of.where("gram = hash").select("hash", F.lit(length).alias("length"), "at", "item", "span"))
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    return all_.distinct()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    span: int = SPAN,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Words of every document that lie in a ``span``-word window of an item (10 words; 5 to 19).

    One narrow pass makes the fingerprints of the documents and meets them with those of the
    items, which are sent to the tasks if they are ``SENT`` rows at most and are shuffled by
    fingerprint otherwise. Each match names one place of an item's window in the document;
    the words there are compared, so no hash decides. What is left is a row for each window
    found in a distinct text. Copies of a text share their rows.

    A window is ``span`` consecutive words of an item; an item of fewer words is one window, one
    of none has none. Result, a row for each document: n_words, n_hit (its words inside any
    occurrence of a window), n_items (items with such windows), items_sha256 (of their ids, sorted
    as strings and joined by commas) and contaminated (n_hit > 0). Null and empty texts have no
    words. Items are told apart by id; texts with one id are one item, items without an id are
    one with an empty id. Repeated documents and null keys give a row each. No documents give no
    rows, no items no hits. Only keys and texts are read, so other columns may have any names.
    """
    if not K <= span < K + PLACES - 1:
        raise ValueError(f"spans have {K} to {K + PLACES - 2} words")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    items = cut_lineage(_items(items, item_key, item_text, span))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # ``span`` at most
    n_words = F.size(_inner(F.split("body", BREAK))).cast("long")
    counted = rows.select("key", F.md5("body").alias("of"), n_words.alias("n_words"))
    if not lengths:
        hits = counted.where("false").select("of", F.col("n_words").alias("n_hit"), F.col("n_words").alias("n_items"), F.col("of").alias("ids"))
    else:
        hits = _hits(rows, _windows(items, lengths), lengths)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(hits, "of", "left").select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _hits(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(of, n_hit, n_items, ids) for each distinct text with a window of an item."""
    windows = cut_lineage(windows)
    few = windows.count() <= SENT
    texts = rows.select(F.md5("body").alias("of"), words_of(F.col("body")).alias("words"))
    seeds = texts.select("of", "words", F.explode(_let(F.col("words"), lambda w: _seeds(w, lengths))).alias("found"))
    seeds = seeds.select("of", "words", "found.length", F.posexplode("found.seeds").alias("window", "seed")).where("seed IS NOT NULL")
    place = F.col("window") + F.pmod(F.col("seed").bitwiseAND(F.lit(PLACES - 1)) - F.col("window"), F.lit(PLACES)).cast("int")
    seeds = seeds.select("of", "words", "length", F.col("seed").bitwiseAND(F.lit(-PLACES)).alias("hash"), place.alias("place"))
    if few:
        windows = F.broadcast(windows)
    else:  # only the words about the gram travel with a seed
        reach = max(lengths)
        least = F.greatest(F.col("place") - reach, F.lit(0))
        seeds = seeds.select(
            "of", "hash", "length", "place", least.alias("least"), F.slice("words", least + 1, 2 * reach + K).alias("words")
        )
    start = F.col("place") - F.col("at")
    met = seeds.join(windows, ["hash", "length"])
    base = F.lit(0) if few else F.col("least")
    same = (start >= base) & (F.slice("words", F.greatest(start - base, F.lit(0)) + 1, F.col("length")) == F.col("span"))
    found = met.where(same).select("of", "item", start.alias("start"), "length").distinct()
    found = cut_lineage(found)
    places = found.select("of", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word"))
    n_hit = places.distinct().groupBy("of").agg(F.count("*").alias("n_hit"))
    named = found.select("of", "item").distinct().groupBy("of")
    named = named.agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("ids"))
    return n_hit.join(named, "of")
