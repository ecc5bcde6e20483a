"""Repeated passages: planted ones are found, chains are the best ones."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from authscope.llm import passages
from authscope.llm.passages import GAP_COST, align, chains, cut_passages, fuzzy_parts, minimizers, repeated_passages

from .conftest import ODD, words


def best_score(x, y, k):
    order = np.lexsort((-y, x))
    x, y, score = x[order], y[order], []
    for j in range(len(x)):
        before = [score[i] - GAP_COST * (x[j] - x[i] + y[j] - y[i]) / 2 for i in range(j) if x[i] < x[j] and y[i] < y[j]]
        score.append(k + max([0, *before]))
    return max(score)


def test_the_first_chain_is_the_best_one():
    r = random.Random(11)
    for _ in range(100):
        n = r.randrange(1, 30)
        x, y = (np.array([r.randrange(60) for _ in range(n)]) for _ in range(2))
        found = chains(x, y, 8, 1)
        assert sorted(i for c in found for i in c.tolist()) == list(range(n))
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in found)
        c = found[0]
        score = 8 * len(c) - GAP_COST * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) / 2
        assert abs(score - best_score(x, y, 8)) < 1e-9


def test_every_window_has_a_minimizer():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    at = minimizers(h, 16)
    assert at[0] < 16 and at[-1] >= len(h) - 16 and np.diff(at).max() <= 16
    assert len(minimizers(h[:0], 16)) == 0 and len(minimizers(h[:5], 16)) == 1


def test_alignment_bridges_edits():
    x = np.arange(100, dtype=np.uint32)
    y = np.concatenate([x[:30], [900, 901], x[30:50], x[53:]]).astype(np.uint32)
    seeds = np.array([(5, 5), (40, 42), (60, 59)])
    matched = align(x, y, seeds[:, 0], seeds[:, 1])
    assert (x[matched[:, 0]] == y[matched[:, 1]]).all() and len(matched) == 97
    (a, b, c, d, share), = fuzzy_parts(matched, 50, 0.8)
    assert (a, b, c, d) == (0, 100, 0, 99) and 0.9 < share < 1


def planted():
    """Documents, and the words of the passages that repeat in later ones."""
    r = random.Random(12)
    docs = [words(r, r.randrange(60, 300), 10**6) for _ in range(40)]
    shared, fuzzy = words(r, 55, 10**6, "p"), words(r, 90, 10**6, "f")
    marks = {}
    for n in (3, 9, 17, 30):
        at = r.randrange(len(docs[n]))
        docs[n][at:at] = shared
        marks[n] = (at, at + 55)
    for n in (5, 21, 22):
        own = list(fuzzy)
        for i in r.sample(range(90), 4 if n > 5 else 0):
            own[i] = f"edit{n}{i}"
        at = r.randrange(len(docs[n]))
        docs[n][at:at] = own
        marks[n] = (at, at + 90)
    docs.append(list(docs[2]))
    return [(i, " ".join(d)) for i, d in enumerate(docs)], marks


def test_planted_passages_are_found_and_clean_documents_left(docs_of):
    rows, marks = planted()
    found = repeated_passages(docs_of(rows + ODD)).collect()
    spans = {}
    for x in found:
        assert x.ref_doc_id < x.doc_id and x.identity >= 0.8 and x.end_word - x.start_word >= 50
        spans.setdefault(x.doc_id, []).append((x.start_word, x.end_word))
    assert set(spans) == {9, 17, 30, 21, 22, 40}
    for n in (9, 17, 30):
        assert spans[n] == [marks[n]]
    for n in (21, 22):
        a, b = min(s for s, _ in spans[n]), max(e for _, e in spans[n])
        assert abs(a - marks[n][0]) <= 5 and abs(b - marks[n][1]) <= 5
    assert spans[40] == [(0, len(rows[40][1].split()))]


def test_cut_texts(docs_of):
    rows, marks = planted()
    docs = docs_of(rows + ODD)
    cut = cut_passages(docs, repeated_passages(docs))
    assert cut.columns == docs.columns
    texts = {}
    for x in cut.collect():
        texts.setdefault(x.doc_id, []).append(x.text)
    assert sum(map(len, texts.values())) == len(rows) + len(ODD)
    for k, text in rows:
        w = text.split()
        if k in (9, 17, 30):
            a, b = marks[k]
            assert texts[k] == [" ".join(w[:a] + w[b:]) + (" " if b == len(w) and a else "")]
        elif k == 40:
            assert texts[k] == [""]
        elif k not in (21, 22):
            assert texts[k] == [text]
    assert texts[900] == [None] and texts[907] == ["twice the same row"] * 2 and texts[None] == ["a row without a key"]
    assert repeated_passages(docs_of([])).count() == 0


def test_partial_copies_in_lower_documents_hide_nothing(docs_of):
    r = random.Random(13)
    rows, marks = [], {}
    for case in range(24):
        n = 80 if case % 3 == 1 else 60
        whole = words(r, n, 10**6, f"c{case}x")
        cuts = [[(0, 30), (30, 60)], [(0, 45), (35, 80)], [(0, 20), (20, 40), (40, 60)]][case % 3]
        parts = [whole[a:b] for a, b in cuts]
        for i, piece in enumerate([*parts, whole, *parts, whole]):  # partial copies between as well
            before, after = words(r, 40, 10**6), words(r, 40, 10**6)
            key = case * 100 + i
            rows.append((key, " ".join(before + piece + after)))
            if i == len(parts) * 2 + 1:
                marks[key] = (case * 100 + len(parts), 40, 40 + n)
    found = {(x.doc_id, x.ref_doc_id, x.start_word, x.end_word) for x in repeated_passages(docs_of(rows)).collect()}
    assert found == {(key, *mark) for key, mark in marks.items()}


def test_every_copy_within_a_document_is_found(docs_of):
    r = random.Random(14)
    passage, other = words(r, 60, 10**6, "p"), words(r, 70, 10**6, "o")
    gap = [words(r, 90, 10**6) for _ in range(12)]
    rows = [
        (1, gap[0] + passage + gap[1] + other + gap[2] + other),
        (2, gap[3] + passage + gap[4] + passage + gap[5] + passage),
        (3, gap[6] + passage[20:40] + gap[7] + passage),  # a quotation before the passage
        (4, other + gap[8] + other + gap[9] + other),
    ]
    found = {(x.doc_id, x.start_word, x.end_word) for x in repeated_passages(docs_of([(k, " ".join(w)) for k, w in rows])).collect()}
    assert found >= {(2, 90, 150), (2, 240, 300), (2, 390, 450), (3, 200, 260), (4, 0, 70), (4, 160, 230), (4, 320, 390)}
    assert {k for k, _, _ in found} == {2, 3, 4}
    longer = [(1, " ".join(passage + gap[10])), (2, " ".join((gap[11] + passage) * 100))]
    found = {(x.start_word, x.end_word) for x in repeated_passages(docs_of(longer)).collect()}
    assert found == {(150 * i + 90, 150 * i + 150) for i in range(100)}


def test_edited_passages_are_found(docs_of):
    r = random.Random(15)
    rows, wanted = [], set()
    for case in range(120):
        n, share = ((60, 0.1), (60, 0.15), (120, 0.2))[case % 3]
        first = words(r, n, 10**6, f"f{case}x")
        second = list(first)
        for i in sorted(r.sample(range(n), round(n * share)), reverse=True):
            how = r.randrange(3)
            second[i : i + (how > 0)] = [f"edit{case}x{i}"] * (how < 2)  # added, replaced or left out
        for key, own in ((2 * case, first), (2 * case + 1, second)):
            rows.append((key, " ".join(words(r, 40, 10**6) + own + words(r, 40, 10**6))))
        wanted.add(2 * case + 1)
    found = repeated_passages(docs_of(rows)).collect()
    assert all(x.identity >= 0.8 and x.end_word - x.start_word >= 48 and x.ref_doc_id == x.doc_id - 1 for x in found)
    assert len({x.doc_id for x in found} & wanted) >= 0.95 * len(wanted)


def test_different_texts_under_one_key(docs_of):
    r = random.Random(16)
    passage = words(r, 60, 10**6, "p")
    rows = [(1, " ".join(passage)), (5, " ".join(words(r, 40) + passage + words(r, 5))), (5, "a short one"), (5, "")]
    for some in (rows, rows[:3], rows[:2], rows[:1] + rows[1:2] * 2):
        docs = docs_of(some)
        cut = sorted((x.doc_id, x.text) for x in cut_passages(docs, repeated_passages(docs)).collect())
        whole = sorted(some)
        assert len(cut) == len(some)
        # the long text is cut if it stands for the key, and no other one is touched
        assert all(got == own or (own == rows[1] and got[1] == " ".join(own[1].split()[:40] + own[1].split()[100:])) for got, own in zip(cut, whole, strict=True))
    assert cut[1] == cut[2] != rows[1]


def test_plain_chains_taken_together_are_those_found_one_by_one():
    """Pairs on one diagonal, at the limit of the gap and beyond it, with repeats and single matches."""
    g, rows = np.random.default_rng(31), []
    for pair in range(300):
        steps = g.choice([1, 3, 5, 20, passages.MAX_GAP + 5, passages.MAX_GAP + 6], g.integers(1, 7))
        x = np.cumsum(steps) + g.integers(0, 9)
        y = x + g.integers(0, 50) + (g.integers(0, 3, len(x)) if pair % 3 == 0 else 0)
        rows += [(pair // 7, 1000 + pair % 7, a, b) for a, b in sorted(zip(x.tolist(), y.tolist())) for _ in range(1 + pair % 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "ref", "x", "y"])
    found = set()
    for out in passages._chained([batch.slice(0, 200), batch.slice(200)], 5):
        found |= {tuple(r.values()) for r in out.to_pylist()}
    want, pairs = set(), {}
    for key, ref, x, y in rows:
        pairs.setdefault((key, ref), {})[x, y] = None
    for (key, ref), at in pairs.items():
        x, y = (np.array(c) for c in zip(*sorted(at)))
        for c in passages.chains(x, y, 5):
            ends = (x[c][0], x[c][-1] + 5, y[c][0], y[c][-1] + 5)
            want.add((key, ref, *map(int, ends), x[c].astype(np.int32).tobytes(), y[c].astype(np.int32).tobytes()))
    assert found == want and len(want) > 200


def test_text_comes_once_before_the_requests_for_it(spark, monkeypatch):
    """A text that many ask for goes to few places, not once to every request."""
    monkeypatch.setattr(passages, "REQUESTS", 8)
    texts = {1: " ".join(words(random.Random(1), 3000)), 2: "one two three four five six"}
    rows = spark.createDataFrame(list(texts.items()), "key long, text string")
    spans = [(own, 1, own, own + 20) for own in range(100, 150)] + [(150, 2, 1, 4)]
    asked = spark.createDataFrame(
        [(own, ref, 0, lo, bytes([1, 0, 0, 0]), bytes([2, 0, 0, 0]), ref, 1, lo, hi) for own, ref, lo, hi in spans],
        "owner long, ref long, own_lo long, rlo long, xs binary, ys binary, of long, role int, from long, to long",
    )
    found = passages._requested(rows, asked, 4)
    got = {r["owner"]: np.frombuffer(r["words"], np.uint32) for r in found.collect()}
    assert len(got) == len(spans)
    for own, ref, lo, hi in spans:
        hashes = passages.word_hashes(pa.array([texts[ref]]))[0] >> np.uint64(32)
        assert np.array_equal(got[own], hashes[max(0, lo - passages.MARGIN) : hi + passages.MARGIN])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" in plan and "SortMergeJoin" not in plan


def test_chains_left_unaligned_hold_no_passage():
    """Chains are ruled out by counts of shared words alone; none of them holds a passage."""
    draw, ruled_out, kept = random.Random(5), 0, 0
    for n in range(300):
        x = [draw.randrange(30) + 100 for _ in range(140)]
        y = [w if draw.random() < n / 300 else draw.randrange(1000) + 1000 for w in x]
        x[70:76], y[70:76] = range(6), range(6)
        one = (np.array(x, np.uint32)[10:], np.array(y, np.uint32)[10:], np.array([60, 61]), np.array([60, 61]))
        found = any(fuzzy_parts(align(*one, cost=c), 50, 0.8) for c in (2, 1))
        may = bool(passages._may_hold([one], 5, 40 - 1e-6)[0])
        assert may or not found
        ruled_out, kept = ruled_out + (not may), kept + found
    assert ruled_out > 50 and kept > 20


def best_stretches(x, y, cost):
    """Matches of the stretches from the start that pay best: the equal start, then by a plain table; of equal ones the first."""
    run = next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    x, y = x[run:], y[run:]
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
    score = (1 + cost) * best - cost * np.maximum(*np.indices(best.shape))
    i, j = np.unravel_index(score.argmax(), score.shape)
    out = []
    while best[i, j]:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((run + i, run + j))
        elif best[i - 1, j] == best[i, j]:
            i -= 1
        else:
            j -= 1
    return [(n, n) for n in range(run)] + out[::-1]


def edited(draw, n):
    """Two stretches of up to 64 words, the second one with words replaced, added or left out."""
    x = [draw.randrange(40) for _ in range(draw.randrange(65))]
    y = []
    for w in x:
        how = draw.random() * 2 * n
        y += [draw.randrange(40)] * (how > 1.2) + [w] * (how < 1 or how > 1.6)
    return np.array(x, np.uint32), np.array(y[:64], np.uint32)


def test_chains_are_aligned_together_as_one_by_one(monkeypatch):
    """Stretches around many chains are compared in a few steps, and each one as by a plain table."""
    draw, found, want = random.Random(41), [], {1: [], 2: []}
    calls = []
    monkeypatch.setattr(passages, "_common", lambda equal, run=passages._common: calls.append(len(equal)) or run(equal))
    for n in range(300):
        (before, ref_before), (after, ref_after) = edited(draw, n / 300), edited(draw, n / 300)
        seed = np.arange(100, 105, dtype=np.uint32)
        x, y = np.concatenate([before[::-1], seed, after]), np.concatenate([ref_before[::-1], seed, ref_after])
        found.append((x, y, np.array([len(before)]), np.array([len(ref_before)])))
        for cost in (1, 2):
            back = [(len(before) - 1 - i, len(ref_before) - 1 - j) for i, j in best_stretches(before, ref_before, cost)]
            on = [(len(before) + 5 + i, len(ref_before) + 5 + j) for i, j in best_stretches(after, ref_after, cost)]
            want[cost].append(back[::-1] + [(len(before) + i, len(ref_before) + i) for i in range(5)] + on)
    chains_ = passages._Chains.of(found)
    for cost in (1, 2):
        matched, first = passages._align(chains_, [passages._before(chains_), passages._after(chains_, 5)], 5, cost)
        assert [list(map(tuple, matched[a:b].tolist())) for a, b in zip(first[:-1], first[1:])] == want[cost]
    assert len(calls) <= 4 and max(calls) > 100


def test_seeds_of_many_documents_are_those_of_each():
    draw = random.Random(42)
    texts = [" ".join(words(draw, draw.choice([0, 1, 4, 5, 6, 9, 10, 11, 80]), draw.choice([3, 10**6]))) for _ in range(200)]

    def seeds(some):
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([t for _, t in some])], ["key", "text"])
        return sorted(tuple(r.values()) for b in passages._seeds([batch], 5, 5) for r in b.to_pylist())

    rows = list(enumerate(texts))
    assert seeds(rows) == sorted(r for row in rows for r in seeds([row]))
    for key, text in rows:
        own = [r for r in seeds([(key, text)]) if r[3] != passages.NUMBERED]
        hashes = passages.word_hashes(pa.array([text]))[0]
        s = passages.shingle_hashes(hashes, 5) if len(hashes) >= 5 else hashes[:0]
        assert sorted(r[2] for r in own) == sorted(minimizers(s, 5).tolist())


def test_a_span_is_one_row_until_its_matches_are_chained():
    """Both ends of a span and the seeds, each match once and in order, whatever the batches."""
    rows = [(1, 0, 7, 3, 0), (1, 0, 7, 3, 4), (1, 0, 2, 1, 9), (1, 0, 11, 7, 0), (4, 2, 5, 5, 0), (4, 3, 5, 5, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "ref", "x", "y", "far"])
    for cut in range(len(rows)):
        found = [tuple(r.values()) for b in passages._with_ends([batch.slice(0, cut), batch.slice(cut)]) for r in b.to_pylist()]
        assert found == [(1, 0, 2, 1), (1, 0, 7, 3), (1, 0, 11, 7), (1, 0, 11, 10), (4, 2, 5, 5), (4, 3, 5, 5), (4, 3, 7, 7)]


def plain_chains(x, y, k):
    """The chains of one pair by a plain table: all matches before one are compared, of equal ones the last is taken."""
    order = sorted(range(len(x)), key=lambda n: (x[n], -y[n]))
    score, back = [], []
    for j in order:
        cost = GAP_COST * (x[j] + y[j]) / 2
        value, n = max(((s + GAP_COST * (x[i] + y[i]) / 2, n) for n, (s, i) in enumerate(zip(score, order)) if x[i] < x[j] and y[i] < y[j]), default=(0, -1))
        score.append(k + max(0, value - cost))
        back.append(n if value > cost else -1)
    left, out = set(range(len(order))), []
    for n in sorted(left, key=lambda n: (-score[n], n)):
        chain = []
        while n in left:
            left.remove(n)
            chain.insert(0, order[n])
            n = back[n]
        part = chain[:1]
        for i in chain[1:]:
            if max(x[i] - x[part[-1]], y[i] - y[part[-1]]) > passages.MAX_GAP + k:
                out, part = [*out, part], []
            part.append(i)
        out += [part] * bool(part)
    return [c for c in out if len(c) > 1]


def test_chains_of_many_pairs_are_found_together(monkeypatch):
    """Pairs of many matches off one diagonal, in any order of the earlier documents, over batches."""
    draw, rows, want, calls = random.Random(43), [], set(), []
    monkeypatch.setattr(passages, "_links", lambda *a, run=passages._links: calls.append(len(a[2]) - 1) or run(*a))
    for key in range(30):
        for ref in draw.sample(range(100, 200), 6):
            wide = draw.choice([8, 40, 300, 3000])
            at = {(a := draw.randrange(wide), draw.choice([a, a + 3, draw.randrange(wide)])) for _ in range(draw.randrange(2, 60))}
            x, y = zip(*at)
            rows += [(key, ref, a, b, 0) for a, b in at]
            for c in plain_chains(x, y, 5):
                want.add((key, ref, tuple(x[i] for i in c), tuple(y[i] for i in c)))
    rows.sort(key=lambda r: (r[0], draw.random()))  # by key alone
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "ref", "x", "y", "far"])
    found = set()
    for out in passages._chained(passages._with_ends(batch.slice(n, 700) for n in range(0, len(rows), 700)), 5):
        for r in out.to_pylist():
            xs, ys = (tuple(np.frombuffer(r[n], np.int32).tolist()) for n in ("xs", "ys"))
            assert (r["lo"], r["hi"], r["rlo"], r["rhi"]) == (xs[0], xs[-1] + 5, ys[0], ys[-1] + 5)
            found.add((r["key"], r["ref"], xs, ys))
    assert found == want and len(want) > 300
    assert len(calls) <= 2 * (len(rows) // 700 + 1) and sum(calls) > 100  # not once a pair


def test_a_group_over_many_batches_is_put_together_once(monkeypatch):
    joined = []
    monkeypatch.setattr(passages.np, "concatenate", lambda c, *a, run=np.concatenate, **k: joined.append(sum(map(len, c))) or run(c, *a, **k))
    key = np.repeat([1, 2, 3], [3, 900, 7])
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(910))], ["key", "n"])
    found = list(passages._groups((batch.slice(n, 10) for n in range(0, 910, 10)), ["key", "n"], ["key"]))
    assert sum(joined) < 3 * 910 * 2
    monkeypatch.undo()
    assert np.concatenate([n for _, n in found]).tolist() == list(range(910))
    assert all(len(set(key[n].tolist()) & {2}) == 0 or (key[n] == 2).sum() == 900 for _, n in found)


def test_rows_of_numbers_are_sorted_and_sent_without_a_look_at_each(spark, docs_of, monkeypatch):
    """Steps on numbers sort by one of them, which takes no comparisons, and their Arrow batches end by rows; texts keep the limit in bytes."""
    limit, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    usual = spark.conf.get(limit)

    def cut(df, run=passages.cut_lineage):
        seen.append((df._jdf.queryExecution().optimizedPlan().toString(), spark.conf.get(limit)))
        return run(df)

    monkeypatch.setattr(passages, "cut_lineage", cut)
    assert len(repeated_passages(docs_of(planted()[0])).collect()) > 5
    assert spark.conf.get(limit) == usual
    numbers = [(plan, now) for plan, now in seen if "_spans" in plan or "<lambda>" in plan and "text#" not in plan]
    assert len(numbers) == 2
    for plan, now in numbers:
        assert now == str(2**31 - 1) and "Sort [key#" in plan and plan.count(" ASC ") == 1
    assert all(now == usual for plan, now in seen if "text#" in plan) and any("text#" in plan for plan, _ in seen)


def test_only_chains_that_may_be_parted_are_traced(monkeypatch):
    """Ends and counts of alignments are those of their matches; whole passages come without tracing all of these."""
    draw, found, traced = random.Random(44), [], []
    for n in range(400):
        (before, ref_before), (middle, ref_middle), (after, ref_after) = (edited(draw, draw.random() / 2) for _ in range(3))
        if n % 4 == 0:  # replaced between the seeds
            ref_middle = middle + np.uint32(1000)
        seed, end = np.arange(100, 105, dtype=np.uint32), np.arange(105, 110, dtype=np.uint32)
        x, y = np.concatenate([before, seed, middle, end, after]), np.concatenate([ref_before, seed, ref_middle, end, ref_after])
        places = [np.array([len(b), len(b) + 5 + len(m)]) for b, m in ((before, middle), (ref_before, ref_middle))]
        found.append((x, y, *places))
    found = passages._Chains.of(found)
    sides = [passages._before(found), passages._after(found, 5)]
    for cost in (1, 2):
        want = passages._parts(*passages._align(found, sides, 5, cost), 40, 0.8)
        with monkeypatch.context() as m:
            m.setattr(passages, "_align", lambda some, *a, run=passages._align: traced.append(len(some.first) - 1) or run(some, *a))
            got = passages._passed(found, passages._within(found, 5, count=True), sides, 5, cost, 40, 0.8)
        rows = [sorted(zip(*(c.tolist() for c in parts))) for parts in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) > 50
    assert len(traced) == 2 and max(traced) < 300


def test_texts_are_compared_only_under_keys_met_twice(docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(passages, "cut_lineage", lambda df, run=passages.cut_lineage: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or run(df))
    texts = [(1, "one"), (2, "two"), (3, None), (None, "a"), (None, "b")]
    assert passages._clashing(docs_of(texts), "doc_id", "text").collect() == [] and not any("md5" in plan for plan in seen)
    clashing = passages._clashing(docs_of([*texts, (2, "two"), (1, "other"), (3, ""), (4, ""), (4, "x")]), "doc_id", "text")
    low = {1: min(map(md5, ("one", "other"))), 4: min(map(md5, ("", "x")))}
    assert {r.twice: r.low for r in clashing.collect()} == low


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()
