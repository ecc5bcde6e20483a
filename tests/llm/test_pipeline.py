"""The pipeline: each stage on what the one before it kept."""

import random

import corpus_pipeline
from tests.llm.conftest import ODD, words
from tests.llm.test_jaccard import by_hand, edited
from tests.llm.test_packing import by_hand as packed_by_hand

import __spark_entry__ as driver


def test_stages_in_order_over_a_small_corpus(spark, tmp_path, docs_of, labels_of):
    r = random.Random(19)
    clean = [" ".join(words(r, r.randrange(60, 200), 10**6)) for _ in range(150)]
    junk = [" ".join(x + "|" for x in words(r, 60)) for _ in range(90)]
    near = [edited(r, clean[i], 1) for i in range(0, 150, 10)]
    passage = " ".join(words(r, 60, 10**6, "p"))
    clean[7] += " " + passage
    clean[90] = passage + " " + clean[90]
    rows = list(enumerate(clean + junk + near))
    docs_of(rows, clashing=False).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of([(i, int(i < 150 or i >= 240), 0) for i in range(0, len(rows), 2)]).write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[n] = {x.doc_id: x for x in docs.collect()} if n < 4 else docs.collect()
    good = set(range(150)) | set(range(240, len(rows)))
    # no good document goes, and the learned rules leave little of the junk
    assert good <= set(kept[0]) and len(set(kept[0]) - good) <= 9
    assert len(good & set(kept[1])) >= 0.97 * len(good)
    left = [(k, x.text) for k, x in sorted(kept[1].items())]
    assert set(kept[2]) == {k for k, name, _ in by_hand(left) if k == name}
    if 7 in kept[2] and 90 in kept[2]:
        assert passage in kept[3][7].text and passage not in kept[3][90].text
    assert set(kept[3]) == set(kept[2]) and all(x.n_chars == len(x.text) for x in kept[3].values())
    free = {}
    for x in kept[4]:
        free[x.sequence_id] = free.get(x.sequence_id, 2048) - x.length
    assert sorted(free.values()) == packed_by_hand([x.length for x in kept[4]], 2048)
    assert {x.doc_id for x in kept[4]} == set(kept[3])
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(x.doc_id for x in kept[4])


def test_every_operator_is_registered():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in driver.queries() and len(corpus_pipeline.STAGES) == 5


def test_odd_rows_pass_all_stages(spark, tmp_path, docs_of, labels_of):
    r = random.Random(20)
    clean = [(i, " ".join(words(r, r.randrange(60, 120), 10**6))) for i in range(60)]
    junk = [(1000 + i, " ".join(x + "|" for x in words(r, 60))) for i in range(40)]
    long_one = (2000, " ".join(words(r, 20_000, 10**6)))
    same_key = [(3, " ".join(words(r, 80, 10**6, "s"))), (3, "")]
    for n, rows in enumerate((clean + junk + [long_one, *same_key] + clean[:5] + ODD, [])):
        docs_of(rows).coalesce(2).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        labels = [(k, int(k < 1000), 0) for k, _ in clean + junk if k % 2]
        labels_of(labels if rows else []).write.parquet(f"{tmp_path}/{n}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{n}/documents.parquet")
        for m, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, f"{tmp_path}/{n}")
            if m < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{n}/out{m}")
            docs = spark.read.parquet(f"{tmp_path}/{n}/out{m}")
        kept = {x.doc_id for x in docs.collect()}
        # resampling draws by weight, so a few rows may go
        assert len(kept & {k for k, _ in clean}) >= 55 if rows else not kept
