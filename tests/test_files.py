"""Files to results: headers, row keys, column names and all routes in one call."""

import random

import pytest
from pyspark.sql import functions as F

from authscope.plans.evaluation import Fit
from authscope.plans.files import Sources, evaluate_files
from authscope.sources import readers
from tests.test_sketches_sliding import jobs_of

HEADER = " Destination Port, Flow Duration,Fwd Header Length.1, Label"


def flow_lines(r, n):
    for i in range(n):
        bad = i % 10 == 0
        yield f"{r.randrange(100)},{r.randrange(50) + 900 * bad},{'Infinity' if i == 3 else r.randrange(9)},{'DDoS' if bad else 'BENIGN'}"


@pytest.fixture
def folder(tmp_path):
    r = random.Random(5)
    (tmp_path / "flows").mkdir()
    for name, header in (("a", HEADER), ("b", HEADER.replace(" Flow", "Flow"))):
        lines = [header, *flow_lines(r, 200)]
        (tmp_path / "flows" / f"{name}.csv").write_text("\n".join(lines + lines[5:9]) + "\n")  # some rows twice
    logins = ["Login Timestamp,User ID,IP Address,Country,User Agent String,Login Successful,Is Attack IP"]
    for i in range(400):
        bad = i % 40 < 8
        logins.append(f"2024-01-0{1 + i % 5} 10:{i % 6}0:00,{i % 30},10.0.0.{i % 40},FR,Firefox,{not bad},{bad}")
    (tmp_path / "logins.csv").write_text("\n".join(logins) + "\n")
    logs = ["ts,user,src_ip,app,result"]
    for i in range(400):
        logs.append(f"2024-01-0{1 + i % 5}T10:{i % 6}0:00,u{i % 30},10.0.0.{i % 40},SSO,{'FAILED' if i % 40 < 8 else 'Ok '}")
    (tmp_path / "logs.csv").write_text("\n".join(logs) + "\n")
    return tmp_path


def test_headers_take_as_many_jobs_for_any_number_of_files(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i:03}.csv").write_text(f'a, "b, c" ,x{i % 3}\n' + f"{i},2,3\n" * (i % 4))
    (tmp_path / "none.csv").write_text("")
    paths = readers.list_files(spark, f"{tmp_path}/*.csv")
    found, jobs = jobs_of(spark, lambda: readers.file_headers(spark, paths))
    # Spark lists the paths, shuffles and reads the result, however many files there are.
    assert jobs <= 3 and jobs_of(spark, lambda: readers.file_headers(spark, paths[:40]))[1] == jobs
    assert len(found) == 200 and {h[0] for h in found.values()} == {"a"}
    plain = {p: tuple(spark.read.option("header", True).csv(p).columns) for p in paths[:3]}
    assert all(found[p][0] == h[0] == "a" and found[p][-1] == h[-1] for p, h in plain.items())


def test_files_of_several_headers_are_one_table(spark, folder):
    df = readers.flow_columns(readers.read_flow_csvs(spark, f"{folder}/flows/*.csv"))
    assert set(df.columns) == {"dst_port", "Flow Duration", "Fwd Header Length_1", "label"}
    assert df.count() == 408 and df.where("`Flow Duration` IS NULL").count() == 0
    typed = readers.read_flow_csvs(spark, f"{folder}/flows/*.csv", {"Flow Duration": "double"})
    assert dict(typed.dtypes)["Flow Duration"] == "double" and dict(typed.dtypes)["Label"] == "string"
    with pytest.raises(FileNotFoundError):
        readers.read_flow_csvs(spark, f"{folder}/nothing/*.csv")


def test_row_keys_are_unique_and_repeatable(spark, folder):
    def keyed():
        return readers.row_keys(readers.read_flow_csvs(spark, f"{folder}/flows/*.csv", {}))

    one, two = ({tuple(r) for r in keyed().select(*readers.ROW_KEY).collect()} for _ in range(2))
    assert len(one) == 408 and one == two
    assert sorted(map(str, keyed().collect())) == sorted(map(str, keyed().collect()))
    assert readers.row_keys(spark.range(0)).count() == 0


def test_all_routes_in_one_call(spark, folder):
    train = spark.range(300).select(
        (F.rand(1) + F.when(F.col("id") % 10 == 0, 9).otherwise(0)).alias("size"),
        F.when(F.col("id") % 10 == 0, "Fuzzers").otherwise("Normal").alias("attack_cat"),
        (F.col("id") % 10 == 0).cast("int").alias("label"),
    )
    for name in ("train", "test"):
        train.write.parquet(f"{folder}/{name}")
    sources = Sources(f"{folder}/flows/*.csv", f"{folder}/logins.csv", f"{folder}/logs.csv", (f"{folder}/train", f"{folder}/test"))
    found = evaluate_files(spark, sources, f"{folder}/summary", window="1h", fit=Fit(trees=20))
    assert set(found) == {"flows-raw", "flows-windowed", "logins", "logs", "flows-split"}
    table = readers.read_results(spark, f"{folder}/summary", "csv").collect()
    assert {x.dataset for x in table} == {"flows-raw", "flows-windowed", "logins", "logs", "flows-split"}
    by_label = {(x.dataset, x.label): x for x in table}
    assert by_label["flows-raw", "DDoS"].recall > 0.5 and by_label["flows-raw", "DDoS"].n == 40
    # eight of forty sources attack, each in one window of an hour
    assert by_label["logins", "Is Attack IP"].n == 8 and by_label["flows-split", "Fuzzers"].recall > 0.9
    some = evaluate_files(spark, Sources(logs=f"{folder}/logs.csv", logins=f"{folder}/none.csv"), window="1h", fit=Fit(trees=5))
    assert set(some) == {"logs"}
    with pytest.raises(FileNotFoundError, match="none of the files"):
        evaluate_files(spark, Sources(flows=f"{folder}/no/*.csv"))
