"""Quality rules: counts by column expressions, and a decision list learned from labels.

Everything here is DataFrame operations; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _neighbours(values: Column) -> Column:
    """Pairs (value, next value) of a sorted array."""
    return F.arrays_zip(
        F.slice(values, 1, F.size(values) - 1).alias("a"), F.slice(values, 2, F.size(values) - 1).alias("b")
    )


def _covered(windows: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more, from an array (hash, position).

    Sorted by hash, equal windows are neighbours; sorted by position, each window adds the
    words up to the next one, ``width`` at most.
    """

    def positions(ordered: Column) -> Column:
        twins = F.filter(_neighbours(ordered), lambda p: p["a"]["h"] == p["b"]["h"])
        return F.array_sort(F.array_distinct(F.flatten(F.transform(twins, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))

    def count(at: Column) -> Column:
        steps = F.aggregate(_neighbours(at), F.lit(0), lambda total, p: total + F.least(F.lit(width), p["b"] - p["a"]))
        return F.when(F.size(at) == 0, 0).otherwise(steps + width)

    return _let(F.sort_array(windows), lambda ordered: _let(positions(ordered), count))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in some ``width``-word window found twice or more, the first one included."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    def count(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(placed, width))

    return _let(words, lambda w: F.when(F.size(w) < width, 0).otherwise(_let(hashes(w), count)))


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", rest: Column | None = None) -> DataFrame:
    """Counts of words, symbols, lines and repeats of every whole text, in one narrow pass.

    ``rest`` is carried along under that name.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def number(pattern: str) -> Column:
        return F.regexp_count("t", F.lit(pattern)).cast("long")

    carried = [] if rest is None else [rest.alias("rest")]
    rows = docs.select(F.col(key).alias("key"), whole.alias("t"), _words(whole).alias("w"), *carried)
    lines = _let(
        F.filter(F.split("t", "\n"), lambda line: F.regexp_like(line, F.lit(WORD))),
        lambda kept: F.struct(F.size(kept).alias("lines"), F.size(F.array_distinct(kept)).alias("distinct")),
    )
    return rows.select(
        "key",
        *(["rest"] if carried else []),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        number(r"[#*$%&|<>]").alias("n_symbols"),
        lines.alias("lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        number(r"\p{Lu}").alias("n_upper"),
        number(r"[!?]").alias("n_shouts"),
        number(r"[0-9]").alias("n_digits"),
    ).select(
        "*",
        F.col("lines.lines").cast("long").alias("n_lines"),
        (F.col("lines.lines") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"),
    ).drop("lines")


#: Statistics that a rule may put a threshold on.
STATISTICS = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "shouts_a_word": "n_shouts / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}

#: A term: statistic, whether values at the threshold and above (or those below) meet it, threshold.
Term = tuple[str, bool, float]


def term_sql(term: Term) -> str:
    name, above, threshold = term
    return f"{STATISTICS[name]} {'>=' if above else '<'} {threshold!r}D"


def rejects(rules: list[list[Term]]) -> Column:
    """The decision list as an ordered conditional: the first rule that holds decides."""
    verdict = None
    for rule in rules:
        holds = F.expr(" AND ".join(f"({term_sql(t)})" for t in rule))
        verdict = F.when(holds, True) if verdict is None else verdict.when(holds, True)
    return F.lit(False) if verdict is None else verdict.otherwise(False)


def learn_decision_list(
    labelled: DataFrame,
    label: str = "bad",
    key: str = "key",
    max_rules: int = 8,
    max_terms: int = 3,
    thresholds: int = 48,
    min_precision: float = 0.9,
    min_covered: int = 5,
) -> list[list[Term]]:
    """Sequential covering: grow a conjunction, prune it, take out what it covers, go on.

    Two thirds of the labelled rows (by a hash of the key) grow a rule, term by term, to the
    best gain of information about bad rows; the last terms that do not pay on the other third
    are cut off. A rule is kept if its precision on that third reaches ``min_precision`` and
    it covers ``min_covered`` bad rows there; the first one that fails ends the list.

    Thresholds are quantiles of the labelled rows, so each row is reduced to small numbers;
    one aggregate over these counts all candidate terms at once. Rows with a null label are
    not used. Without bad rows the list is empty.
    """
    names = list(STATISTICS)
    rows = labelled.where(F.col(label).isNotNull()).select(
        F.col(label).cast("boolean").alias("bad"),
        (F.pmod(F.xxhash64(key), F.lit(3)) > 0).alias("grow"),
        *(F.expr(sql).alias(name) for name, sql in STATISTICS.items()),
    )
    # Quantiles of the bad rows and of the good ones: rare bad values get thresholds too.
    shares = [(i + 0.5) / thresholds for i in range(thresholds)]
    found = rows.groupBy("bad").agg(*(F.percentile_approx(n, shares, 2000).alias(n) for n in names)).collect()  # two rows
    cuts = {n: sorted({v for row in found for v in row[n]}) for n in names}
    if not any(row["bad"] for row in found):
        return []

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.lit(cuts[name]), lambda c: F.col(name) >= c)).cast("short").alias(name)

    binned = cut_lineage(rows.select("bad", "grow", *map(bin_of, names)))

    def meets(name: str, above: bool, number: int) -> Column:
        return F.col(name) >= number if above else F.col(name) < number

    def all_of(terms: list) -> Column:
        out = F.lit(True)
        for t in terms:
            out = out & meets(*t)
        return out

    def gain(p: int, n: int, p0: int, n0: int) -> float:
        """Information about bad rows that a term adds, times the bad rows it keeps."""
        from math import log2

        return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0

    def grow(left: Column) -> list:
        terms: list = []
        while len(terms) < max_terms:
            held = binned.where(left & F.col("grow") & all_of(terms))
            cells = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names))
            seen = (
                held.select("bad", F.explode(cells).alias("cell"))
                .groupBy("cell.name", "cell.bin")
                .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
                .collect()
            )  # statistics x thresholds
            best, choice, total = 0.0, None, [0, 0]
            for name in names:
                by_bin = {r["bin"]: (r["p"], r["n"]) for r in seen if r["name"] == name}
                p0, n0 = sum(p for p, _ in by_bin.values()), sum(n for _, n in by_bin.values())
                total, p, n = [p0, n0], 0, 0
                for number in range(1, len(cuts[name]) + 1):
                    below = by_bin.get(number - 1, (0, 0))
                    p, n = p + below[0], n + below[1]
                    for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if p0 and (g := gain(a, b, p0, n0)) > best:
                            best, choice = g, (name, above, number)
            if choice is None or not total[1]:  # nothing gained, or no good row left to keep out
                break
            terms.append(choice)
        return terms

    def prune(left: Column, terms: list) -> list:
        counts = binned.where(left & ~F.col("grow")).agg(
            *(F.count_if(F.col("bad") & all_of(terms[: k + 1])).alias(f"p{k}") for k in range(len(terms))),
            *(F.count_if(~F.col("bad") & all_of(terms[: k + 1])).alias(f"n{k}") for k in range(len(terms))),
        ).first()
        scored = [(counts[f"p{k}"], counts[f"n{k}"], k) for k in range(len(terms))]
        value, k = max(((p - n) / (p + n) if p + n else -1.0, -k) for p, n, k in scored)
        p, n, k = scored[-k]
        return terms[: k + 1] if p >= min_covered and p >= min_precision * (p + n) else []

    rules, left = [], F.lit(True)
    while len(rules) < max_rules:
        terms = grow(left)
        terms = prune(left, terms) if terms else []
        if not terms:
            break
        rules.append([(n, above, float(cuts[n][number - 1])) for n, above, number in terms])
        left = left & ~all_of(terms)
    return rules


FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _learned(counts: DataFrame, labels: DataFrame, key: str, label: str) -> list[list[Term]]:
    bad = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.min(label) == 0).alias("bad"))
    return learn_decision_list(counts.join(bad, "key"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, list[list[Term]]]:
    """Counts, base rules and the learned verdict for every document; and the learned rules.

    A label of 0 marks a bad row. A document fails the base rules with fewer than 20 words, or
    with more than 30 % of them in repeated windows; it is kept if neither these nor a learned
    rule reject it. A null or empty text has no words, so it fails. Repeated rows get the same
    verdict; without labels only the base rules hold. The counts are written once, as they are
    read for learning and for judging. Only the key and the text are read from ``docs``.
    """
    counts = cut_lineage(text_counts(docs, key, text))
    rules = _learned(counts, labels, key, label)
    judged = counts.withColumn("base_failed", F.expr(FAILED)).withColumn("kept", ~F.col("base_failed") & ~rejects(rules))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(F.col("key").alias(key), *names), rules


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all columns.

    Texts are not shuffled: counts are written for learning, and each row is counted again
    where it lies to judge it.
    """
    rules = _learned(cut_lineage(text_counts(docs, key, text)), labels, key, label)
    rest = F.struct(*(F.col(f"`{n}`") for n in docs.columns))
    kept = text_counts(docs, key, text, rest).where(~F.expr(FAILED) & ~rejects(rules))
    return kept.select(*(F.col(f"rest.`{n}`").alias(n) for n in docs.columns))
