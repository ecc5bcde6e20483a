"""Quality rules, importance resampling, toxicity and language against plain Python and held-out rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from authscope.llm.language import Model, WordScores, best_paths, identify, label, scripts_of
from authscope.llm.quality_model import _target_half, keep_resampled, kth_largest, ngram_buckets, resample
from authscope.llm.rules import judge, keep_good, rejects, term_sql, text_counts
from authscope.llm.toxicity import fit_nnpu, score_toxicity

from .conftest import ODD, known, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def clean_and_junk(n=300):
    r = random.Random(13)
    rows, labels = [], []
    for i in range(n):
        w = words(r, r.randrange(25, 120), 400)
        bad = i % 6 == 0
        if bad:
            w = [x + r.choice(["%%%", "###", "|"]) for x in w] if i % 12 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_counts_are_those_of_plain_python(docs_of):
    r = random.Random(14)
    rows = list(ODD)
    for i in range(150):
        w = words(r, r.randrange(80), 12)
        text = "".join(x + r.choice([" ", "  ", "\n", "\t", "\x0b", "\n\n", " # ", "|\n"]) for x in w)
        rows.append((i, text + text[: r.randrange(len(text) + 1)]))
    rows.append((1000, " ".join(words(r, 8, 10)) + " " + "a b c d e f g h i " * 300))
    found = text_counts(docs_of(rows)).select("key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((known(x[0]), *x[1:]) for x in found.collect()) == sorted((known(k), *counts(t)) for k, t in rows)


def meets(rule, row):
    """A rule by hand, over the names and numbers of its terms."""
    return all(eval(term_sql(t).replace("greatest", "max").replace("double", "float").rstrip("D"), {"max": max, "float": float}, row) for t in rule)


def test_learned_rules_reject_junk_alone(docs_of, labels_of):
    rows, labels = clean_and_junk()
    judged, rules = judge(docs_of(rows + ODD), labels_of(labels))
    assert rules
    found = {x.doc_id: x for x in judged.collect()}
    assert all(found[i].kept == (i % 6 > 0) for i, _ in rows)
    assert all(found[k].base_failed and not found[k].kept for k in (900, 901, 902, 903))
    kept = keep_good(docs_of(rows + ODD), labels_of(labels))
    assert kept.columns == docs_of(rows).columns
    assert sorted(x.doc_id for x in kept.collect()) == [i for i, _ in rows if i % 6]
    # the ordered conditional is the list of rules
    stats = text_counts(docs_of(rows)).withColumn("bad", rejects(rules))
    for x in stats.collect():
        assert x.bad == any(meets(rule, x.asDict()) for rule in rules)


def test_rules_without_labels_or_rows(docs_of, labels_of):
    rows, _ = clean_and_junk(30)
    for labels in ([], [(None, 0, 0), (3, None, 0)], [(1, 1, 0)]):
        judged, rules = judge(docs_of(rows), labels_of(labels))
        assert rules == [] and all(x.kept != x.base_failed for x in judged.collect())
    assert judge(docs_of([]), labels_of([]))[0].count() == 0


def test_ngram_buckets_do_not_cross_texts():
    texts = ["ab cd!! ef", None, "", "x", "a b", " ... "]
    places, first = ngram_buckets(pa.array(texts))
    assert np.diff(first).tolist() == [7, 0, 0, 1, 3, 1]
    for t, a, b in zip(texts, first, first[1:]):
        assert ngram_buckets(pa.array([t], pa.string()))[0].tolist() == places[a:b].tolist()


def test_kth_largest_is_exact(spark):
    r = random.Random(15)
    values = [r.choice([r.gauss(0, 1e5), r.random(), 3.0, -7.0]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 77, 250, 499, 500):
        assert kth_largest(df, "x", k, bins=8) == sorted(values, reverse=True)[k - 1]


def test_resampling_keeps_clean_text(docs_of, labels_of):
    rows, labels = clean_and_junk(600)
    docs, marked = docs_of(rows + ODD), labels_of(labels)
    found = {x.doc_id: x for x in resample(docs, marked).collect()}
    clean = [found[i].kept for i, _ in rows if i % 6]
    junk = [found[i].kept for i, _ in rows if i % 6 == 0]
    assert sum(clean) > 0.97 * len(clean) and sum(junk) < 0.1 * len(junk)
    assert found[900].log_weight == found[901].log_weight == 0
    kept = keep_resampled(docs, marked)
    assert kept.columns == docs.columns
    want = sorted(known(x.doc_id) for x in resample(docs, marked).collect() if x.kept)
    assert sorted(known(x.doc_id) for x in kept.collect()) == want
    # the largest noisy weights are kept, whatever the partitions
    cut = min(x.noisy_weight for x in found.values() if x.kept)
    assert all(x.kept == (x.noisy_weight >= cut) for x in found.values())
    again = {x.doc_id: x.noisy_weight for x in resample(docs.repartition(7), marked).collect()}
    assert all(abs(again[k] - x.noisy_weight) < 1e-6 for k, x in found.items())


def test_resampling_weights_and_draw_are_those_of_plain_python(docs_of, labels_of, spark):
    """Buckets so many that no two n-grams share one: counts, ratio, weights, cut and draw by hand."""
    r, some, buckets = random.Random(21), ["ab", "cd", "ef", "12", "x9", "gh", "zz", "%%", "!"], 1 << 20
    rows = [(i, " ".join(r.choices(some[: 5 + i % 5], k=r.randrange(1, 40)))) for i in range(160)] + [(500, ""), (501, None)]
    labels = [(i, int(i % 5 < 3), 0) for i in range(0, 160, 2)] + [(3, None, 0), (None, 1, 0), (777, 1, 0)]
    found = {x.doc_id: x for x in resample(docs_of(rows), labels_of(labels), keep=0.9, buckets=buckets).collect()}

    def grams(text):
        t = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", text or "")
        return [(x,) for x in t] + list(zip(t, t[1:]))

    ids = spark.createDataFrame([(k,) for k, _ in rows], "doc_id long")
    in_target = {x.doc_id for x in ids.where(_target_half("doc_id")).collect()}
    good = {k for k, q, _ in labels if q == 1}
    raw, target = Counter(), Counter()
    for k, text in rows:
        raw.update(grams(text))
        if k in good and k in in_target:
            target.update(grams(text))
    sizes = [sum(c.values()) + buckets for c in (target, raw)]
    weight = {k: sum(math.log((target[g] + 1) / sizes[0]) - math.log((raw[g] + 1) / sizes[1]) for g in grams(t)) for k, t in rows}
    assert len({g for _, t in rows for g in grams(t)}) > 60 and 0 < len(good & in_target) < len(good)
    for k, w in weight.items():
        assert abs(found[k].log_weight - w) < 1e-6
    others = sorted((found[k].log_weight for k in good - in_target if k in found), reverse=True)
    least = others[math.ceil(0.9 * len(others)) - 1]
    n = sum(x.log_weight >= least for x in found.values())
    drawn = sorted(found, key=lambda k: -found[k].noisy_weight)[:n]
    assert 0 < n < len(rows) and {k for k, x in found.items() if x.kept} == set(drawn)


def test_resampling_without_labels_or_rows(docs_of, labels_of):
    rows, _ = clean_and_junk(20)
    assert all(x.kept for x in resample(docs_of(rows), labels_of([(None, 1, 0), (2, None, 0)])).collect())
    assert resample(docs_of([]), labels_of([(1, 1, 0)])).count() == 0


def test_toxicity_weights_are_those_of_numerical_derivatives():
    """All rows in one batch: the steps follow the corrected risk, also where its bracket is negative.

    Derivatives by complex steps, which round nothing away.
    """
    g, turned = np.random.default_rng(22), []
    for prior, epochs in ((0.2, 12), (0.7, 60)):
        sets = [{tuple(np.flatnonzero(g.random(9) < p)) for _ in range(n)} for n, p in ((40, np.linspace(0.9, 0.1, 9)), (90, np.linspace(0.2, 0.6, 9)))]
        positive, unlabelled = ([np.array(t, np.int32) for t in sorted(s) if t] for s in sets)
        found = fit_nnpu(positive, unlabelled, prior, epochs, batch=len(unlabelled), decay=1e-3, screen=0.0)
        p, u = (np.array([[i in set(t.tolist()) for i in range(9)] + [1] for t in rows], float) for rows in (positive, unlabelled))

        def clean(w):
            return np.log1p(np.exp(u @ w)).mean() - prior * np.log1p(np.exp(p @ w)).mean()

        def aim(w, on):
            return prior * np.log1p(np.exp(-(p @ w))).mean() + clean(w) if on else -clean(w)

        w, m, v = np.append(np.zeros(9), np.log(prior / (1 - prior))), np.zeros(10), np.zeros(10)
        for step in range(1, epochs + 1):
            on = clean(w) >= 0
            turned.append(not on)
            grad = np.array([aim(w + e, on).imag / 1e-20 for e in np.eye(10) * 1e-20j]) + 1e-3 * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.testing.assert_allclose(np.append(found[:9], found[-1]), w, rtol=1e-6)
        assert not found[9:-1].any()
    assert any(turned) and not all(turned)


def test_toxicity_on_held_out_rows(docs_of, labels_of):
    r = random.Random(16)
    rows, labels = [], []
    for i in range(900):
        w = words(r, r.randrange(10, 80), 800)
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["Vile", "vile", "nasty", "foul,"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0:  # half of the toxic rows are unlabelled
            labels.append((i, 1, int(toxic)))
    found = {x.doc_id: x for x in score_toxicity(docs_of(rows + ODD), labels_of(labels)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) for i, _ in rows)
    right = sum(found[i].predicted == (i % 8 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in found.values())
    assert found[900].score == found[901].score == found[902].score < 0.5
    assert not found[None].held_out
    for none in ([], [(1, 1, 0)], [(None, 1, 1), (2, 1, None)]):
        assert {x.score for x in score_toxicity(docs_of(rows[:20]), labels_of(none)).collect()} <= {1 / (1 + np.exp(40.0))}
    assert score_toxicity(docs_of([]), labels_of(labels)).count() == 0


def test_best_paths_are_those_of_all_paths():
    g = np.random.default_rng(17)
    for _ in range(40):
        sizes = g.integers(0, 7, 5)
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        scores = (-g.random((first[-1], 3)) * 6).astype(np.float32)
        if not first[-1]:
            continue
        path = best_paths(scores, first, 3.0)

        def value(a, p):
            return sum(scores[a + j, s] for j, s in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:]))

        for a, b in zip(first, first[1:]):
            if b > a:
                best = max(value(a, p) for p in itertools.product(range(3), repeat=int(b - a)))
                assert abs(value(a, path[a:b]) - best) < 1e-4


def test_scripts_narrow_candidates():
    assert scripts_of("aéжβ中").tolist() == [0, 0, 2, 1, 13]
    grams = np.random.default_rng(1).integers(0, 50, (1 << 15, 2))
    letters = np.zeros((15, 2))
    letters[0, 0], letters[2, 1] = 100, 100  # one language writes Latin, the other Cyrillic
    langs, sure, spans = label(["abc жук", "слово и дело", "word", "12 ..", "中"], WordScores(Model(["la", "cy"], grams, letters)))
    assert langs[1:4] == ["cy", "la", "und"] and sure[3] == 0.0 and spans[3] == []
    assert langs[4] in ("la", "cy")


def test_languages_and_spans_on_held_out_rows(docs_of):
    r = random.Random(18)
    sounds = {"aa": ["ka", "ro", "mi", "tel"], "bb": ["sch", "ung", "ei", "pf"], "cc": ["жу", "ко", "ли"]}

    def text(lang, n):
        return " ".join("".join(r.choices(sounds[lang], k=r.randrange(1, 4))) for _ in range(n))

    rows = [(i, text(lang := r.choice("abc") * 2, r.randrange(5, 60)), lang) for i in range(400)]
    rows += [(1000, text("aa", 40) + " " + text("bb", 60), None), *ODD]
    found = {x.doc_id: x for x in identify(docs_of(rows)).collect()}
    for i, _, lang in rows[:400]:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert found[i].lang_pred == lang or not found[i].held_out
    mixed = found[1000]
    assert mixed.lang_pred == "bb" and [s.lang for s in mixed.spans] == ["aa", "bb"] and abs(mixed.spans[0].end_word - 40) <= 3
    assert all(found[k].lang_pred == "und" and found[k].score == 0 and found[k].spans == [] for k in (900, 901, 902))
    assert all(0 <= x.score <= 1 for x in found.values())
    assert {x.lang_pred for x in identify(docs_of([(1, "a b", None), (2, None, "aa")])).collect()} == {"und"}
    assert identify(docs_of([])).count() == 0
