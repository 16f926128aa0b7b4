import csv
import glob
import gzip
import os
import random
import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom import schema
from pairloom.schema import (
    MissingColumnsError, apply_null_policy, null_report, require_columns, with_row_key,
)
from pairloom.session import discard, materialise, shared_path
from pairloom.sources import files, prepared, sinks

TRIPLET = "anchor string, positive string, negative string"


def test_missing_columns_are_named(spark):
    with pytest.raises(MissingColumnsError) as error:
        require_columns(spark.range(1), ["anchor", "id", "negative"], "train")
    assert error.value.missing == ["anchor", "negative"]


def test_copies_get_distinct_keys_and_hot_groups_are_expanded_in_parts(spark):
    rows = [("a", "b", None)] * 25 + [("a", None, "b")] * 2 + [("x", "y", "z")]
    frame = spark.createDataFrame(rows, TRIPLET)
    keyed = with_row_key(frame, chunk=4)
    assert keyed.count() == 28
    assert keyed.select("row_key").distinct().count() == 28
    hot = keyed.where("negative IS NULL").select("occurrence").collect()
    assert sorted(r[0] for r in hot) == list(range(1, 26))
    whole = with_row_key(frame.repartition(5), chunk=1000)
    assert sorted(r["row_key"] for r in keyed.collect()) == sorted(
        r["row_key"] for r in whole.collect()
    )


def test_null_policies(spark):
    frame = spark.createDataFrame([("a", None, "c"), ("d", "e", "f")], TRIPLET)
    assert [tuple(r) for r in apply_null_policy(frame).collect()] == [("d", "e", "f")]
    literal = sorted(tuple(r) for r in apply_null_policy(frame, "literal").collect())
    assert literal == [("a", "nan", "c"), ("d", "e", "f")]
    assert tuple(null_report(frame).first()) == (1, 1)
    with pytest.raises(ValueError):
        apply_null_policy(frame, "other")


@pytest.fixture
def csv_dir(tmp_path):
    (tmp_path / "a_supervised.csv").write_text(
        'anchor,positive,negative_1,negative_2\n'
        '"said ""so"", then",  two words ,"line one\nline two",x\n'
        "nan,p2,,y\n",
        encoding="utf-8",
    )
    (tmp_path / "b_supervised.csv").write_text(
        "negative_1,extra,positive,anchor\n나,1,다,가\n", encoding="utf-8"
    )
    (tmp_path / "c_supervised.csv").write_text("anchor,positive\nq,r\n", encoding="utf-8")
    (tmp_path / "other.csv").write_text("anchor,positive\nno,no\n", encoding="utf-8")
    return tmp_path


def test_supervised_files_are_read_by_name(spark, csv_dir):
    found = files.read_supervised(spark, f"{csv_dir}/*_supervised.csv")
    rows = sorted(
        (tuple(r[c] for c in ("anchor", "positive", "negative_1", "source_file")) for r in found.collect()),
        key=str,
    )
    assert rows == sorted(
        [
            ('said "so", then', "  two words ", "line one\nline two", "a_supervised.csv"),
            (None, "p2", None, "a_supervised.csv"),
            ("가", "다", "나", "b_supervised.csv"),
            ("q", "r", None, "c_supervised.csv"),
        ],
        key=str,
    )


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_are_split_also_within_values(spark, tmp_path, small_splits):
    rows = [(f"a, {i}", f"p{i}", f'q "{i}"') for i in range(2000)]
    broken = rows + [("x\ny", "p", "q\n\nr" * (5000 if i == 3 else 1) + str(i)) for i in range(50)] + rows
    for name, found in (("plain a+b%41_supervised.csv", rows), ("broken_supervised.csv", broken)):
        with open(tmp_path / name, "w", newline="") as out:
            csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(
                [("anchor", "positive", "negative_1"), *found]
            )
    wanted = ["anchor", "positive", "negative_1"]
    read = files.read_csv_by_header(spark, f"{tmp_path}/*_supervised.csv", wanted)
    assert read.rdd.getNumPartitions() > 20
    found = sorted((r["anchor"], r["positive"], r["negative_1"], r["source_file"]) for r in read.collect())
    assert found == sorted(
        [(*r, "plain a+b%41_supervised.csv") for r in rows] + [(*r, "broken_supervised.csv") for r in broken]
    )


@pytest.mark.parametrize("ends", ["\n\n", "\r\n\n", "\n\r\n", "\r\n\r\n"])
@pytest.mark.parametrize("rows", [1, 3000])
def test_line_ends_give_the_same_rows_at_every_size(spark, tmp_path, small_splits, ends, rows):
    line = "\r\n" if ends.endswith("\r\n") else "\n"
    header = "\r\n" if ends.startswith("\r\n") else "\n"
    body = "".join(f'a{i},"b\rc",c{i}{line}{line}' for i in range(rows))
    (tmp_path / "t.csv").write_bytes(f"\ufeffanchor,positive,negative{header}{body}".encode())
    found = files.read_csv_by_header(spark, f"{tmp_path}/t.csv", ["anchor", "positive", "negative"]).collect()
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted((f"a{i}", "b\rc", f"c{i}") for i in range(rows))


def test_record_values(spark):
    records = ['a,"b ""c"", d",,"e\nf"', "", ",", '"x"y"z,"', ' "a",b" c,"d"']
    frame = spark.createDataFrame([(r,) for r in records], "r string")
    found = [tuple(r) for r in frame.select(F.inline(files.record_values(F.col("r"), F.array(*map(F.lit, range(4))), "wxyz"))).collect()]
    assert found == [
        ("a", 'b "c", d', "", "e\nf"), ("", None, None, None), ("", "", None, None), ('xy"z', "", None, None),
        (' "a"', 'b" c', "d", None),
    ]


def by_pandas(path):
    frame = pd.read_csv(path, dtype=str, keep_default_na=False, na_values=list(files.MISSING_WORDS))
    return sorted((tuple(None if v != v else v for v in row) for row in frame.values.tolist()), key=str)


def by_spark(spark, path):
    found = files.read_csv_by_header(spark, str(path), ["a", "b", "c"]).collect()
    return sorted((tuple(r)[:3] for r in found), key=str)


ODD_LINES = [
    '5" disk,p2,n2\n', 'q, "r",s\n', '"x"y"z,1,2\n', 'p,"two\nlines, ""q"" ",z\r\n', "u,v,w\r\n", '1,"a\rb",2\n', "one,two\n",
    '"","",""\n', " \t\n", "\n", "\r\n", ",,\n", 'a,b,"\n\n\n"\n', '"""",","",","\r\n"\n', "x,y,z\ry,z,x\r\n", 'e,"f""",g\n', '"a"" ",b,c"\n',
    "nan,NULL,ok\n", "끝,\u2028ü,\u0085\n",
]


def test_odd_lines_equal_pandas(spark, tmp_path):
    cases = [*([line] for line in ODD_LINES), ODD_LINES, ODD_LINES[:2]]
    for i, lines in enumerate(cases):
        (tmp_path / f"odd [{i}].csv").write_bytes(("a,b,c\n" + "k,l,m\n" + "".join(lines) + "k,l,m\na,b,c").encode())
    found = {}
    for row in files.read_csv_by_header(spark, f"{tmp_path}/*.csv", ["a", "b", "c"]).collect():
        found.setdefault(row["source_file"], []).append(tuple(row)[:3])
    for i in range(len(cases)):
        name = f"odd [{i}].csv"
        assert sorted(found[name], key=str) == by_pandas(tmp_path / name), cases[i]


@pytest.mark.parametrize("seed", range(2))
def test_random_records_across_splits_equal_pandas(spark, tmp_path, seed):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rng = random.Random(seed)
        for name in ("t.csv", "u.csv"):
            rows = []
            for i in range(300):
                rows.append(rng.choice(ODD_LINES))
                if rng.random() < 0.2:
                    rows.append('"' + "".join(rng.choice(["\n", '""', ",", "x", " "]) for _ in range(rng.randrange(400))) + '",b,c\n')
            (tmp_path / name).write_bytes(("a,b,c\r\n" + "".join(rows)).encode())
            assert by_spark(spark, tmp_path / name) == by_pandas(tmp_path / name)
        both = files.read_csv_by_header(spark, f"{tmp_path}/*.csv", ["c", "b"])
        assert both.count() == sum(len(by_pandas(tmp_path / n)) for n in ("t.csv", "u.csv"))
        assert both.select("source_file").distinct().count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_odd_files_are_neither_written_nor_shuffled(spark, tmp_path):
    """Only the splits' states are written; exchanges move what a split begins or ends with."""
    text = "\n".join(f"word {i}" for i in range(20))
    pd.DataFrame({"a": [f"{i}\n{text}" for i in range(3000)]}).to_csv(tmp_path / "odd.csv", index=False)
    before = set(glob.glob(os.path.dirname(shared_path(spark, "x")) + "/*"))
    frame = files.read_csv_by_header(spark, str(tmp_path / "odd.csv"), ["a"])
    assert sorted(r.a for r in frame.collect()) == sorted(f"{i}\n{text}" for i in range(3000))
    made = set(glob.glob(os.path.dirname(shared_path(spark, "x")) + "/*")) - before
    written = sum(os.path.getsize(f) for folder in made for f in glob.glob(f"{folder}/*.parquet"))
    assert written < 20_000 < os.path.getsize(tmp_path / "odd.csv")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT whole" in plan and plan.count("Window") == 1


def test_plain_files_are_parsed_by_the_scan(spark, tmp_path):
    (tmp_path / "p.csv").write_text('x,a,b,c\n1,"q, ""r""",5" disk,z\n' * 3)
    read = files.read_csv_by_header(spark, f"{tmp_path}/p.csv", ["a", "b", "c"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan and "Python" not in plan and "Exchange" not in plan
    assert sorted(tuple(r)[:3] for r in read.collect()) == [("a", "b", "c")] * 2 + [('q, "r"', '5" disk', "z")] * 3


def test_missing_texts_of_triplets_follow_the_policy(spark, tmp_path):
    (tmp_path / "t.csv").write_text("anchor,positive,negative\na,b,c\nd,,f\nnan,h,i\n")
    assert [r["anchor"] for r in files.read_triplets(spark, f"{tmp_path}/t.csv").collect()] == ["a"]
    kept = files.read_triplets(spark, f"{tmp_path}/t.csv", null_policy="literal").collect()
    assert sorted(r["anchor"] + r["positive"] for r in kept) == ["ab", "dnan", "nanh"]


def test_no_files_and_missing_columns(spark, csv_dir):
    with pytest.raises(files.NoInputFilesError):
        files.read_supervised(spark, f"{csv_dir}/*_nothing.csv")
    with pytest.raises(MissingColumnsError):
        files.read_supervised(spark, f"{csv_dir}/other.csv")
    with pytest.raises(MissingColumnsError):
        files.read_detailed(spark, f"{csv_dir}/other.csv")
    with pytest.raises(MissingColumnsError):
        files.read_triplets(spark, f"{csv_dir}/other.csv")


def test_csv_round_trip_keeps_odd_texts(spark):
    rows = [(' lead, "q"', "two\nlines", "tab\there ", "v", "train"), ("x\\y", "'", "끝", "v", "train")]
    frame = spark.createDataFrame(rows, f"{TRIPLET}, data_version string, split string")
    path = shared_path(spark, "odd") + "/odd.csv"
    sinks.csv_writer(frame.select("anchor", "positive", "negative")).csv(path)
    back = files.read_triplets(spark, path).select("anchor", "positive", "negative")
    assert sorted(map(tuple, back.collect())) == sorted(r[:3] for r in rows)


def test_whole_preparation(spark, csv_dir):
    (csv_dir / "top20.csv").write_text(
        "rank,anchor,original_positive,best_other_positive\n1,a1,p1,n1\n2,a2,p2,n2\n"
    )
    path = shared_path(spark, "prepared")
    report = prepared.prepare(
        spark, f"{csv_dir}/*_supervised.csv", f"{csv_dir}/top20.csv", path, null_policy="literal"
    )
    sizes = {(r["data_version"], r["split"]): r["n_rows"] for r in report.collect()}
    assert sizes == {
        ("supervised_only", "train"): 3, ("supervised_only", "test"): 1,
        ("supervised_with_detailed", "train"): 5, ("supervised_with_detailed", "test"): 1,
    }
    train = files.read_version_split(spark, path, "supervised_with_detailed", "train")
    assert train.where("source_kind = 'detailed'").count() == 2
    scan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data_version" in scan


def test_sampling_on_read(spark):
    path = shared_path(spark, "many")
    spark.range(300).selectExpr(
        "cast(id % 40 as string) anchor", "'p' positive", "'n' negative"
    ).write.parquet(path)
    found = files.read_triplets(spark, path, max_samples=100, fmt="parquet")
    assert found.count() == 100 and found.select("row_key").distinct().count() == 100
    assert files.read_triplets(spark, path, max_samples=1000, fmt="parquet").count() == 300


def test_line_numbers_across_blocks(spark):
    frame = spark.range(1000).select(
        F.col("id").alias("event_id"), (F.col("id") % 3 % 2).cast("string").alias("run")
    )
    found = files.number_lines(frame, ["run"], "event_id", block=64).collect()
    for run in ("0", "1"):
        lines = sorted((r["event_id"], r["line_no"]) for r in found if r["run"] == run)
        assert [n for _, n in lines] == list(range(len(lines)))


def test_materialised_table_prunes(spark):
    table = materialise(spark.range(10).selectExpr("id", "id % 2 as side"), "t", ["side"])
    plan = table.where("side = 1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(side" in plan
    assert os.path.isdir(spark.conf.get("spark.checkpoint.dir"))


def test_written_tables_can_be_deleted(spark):
    table = materialise(spark.range(10), "gone")
    path = table._scratch_path
    assert os.path.isdir(path.removeprefix("file:"))
    discard(table, spark.range(1))
    assert not os.path.exists(path.removeprefix("file:"))


def test_rebalanced_splits_hold_the_same_rows_in_fewer_files(spark):
    frame = spark.range(400, numPartitions=20).selectExpr(
        "id as row_key", "concat('v', id % 2) as data_version", "if(id % 10 = 0, 'test', 'train') as split"
    )
    plain, even = shared_path(spark, "plain"), shared_path(spark, "even")
    sinks.write_splits(frame, plain)
    sinks.write_splits(frame, even, rebalance=True)
    assert sorted(spark.read.parquet(even).collect()) == sorted(spark.read.parquet(plain).collect())
    assert len(spark.read.parquet(even).inputFiles()) < len(spark.read.parquet(plain).inputFiles())


def test_rows_without_copies_stay_where_they_are(spark, monkeypatch):
    rows = [("a", "b", None)] * 25 + [("a", None, "b")] * 2 + [(str(i), "y", None if i % 2 else "z") for i in range(300)]
    frame = materialise(spark.createDataFrame(rows, TRIPLET).repartition(7), "rows")
    want = sorted(map(tuple, with_row_key(frame).collect()), key=str)
    keyed = schema.with_row_key_in_place(frame, chunk=4)
    assert keyed.columns == with_row_key(frame).columns
    assert sorted(map(tuple, keyed.collect()), key=str) == want
    # rows whose hashes share a slot with that of a copy
    monkeypatch.setattr(schema, "COPY_SLOTS", 64)
    assert sorted(map(tuple, schema.with_row_key_in_place(frame).collect()), key=str) == want
    assert schema.with_row_key_in_place(frame.where("false")).count() == 0


def test_what_was_shuffled_goes_when_a_table_is_written(spark):
    held = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {b for b in store.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}

    before = shuffled()
    table = materialise(spark.range(10_000).repartition(8, "id"), "dealt")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and table.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == held


def test_compressed_files_are_read_and_sources_may_go_early(spark, csv_dir):
    folder = csv_dir / "d_supervised.csv"
    folder.mkdir()
    with gzip.open(folder / "part-0.csv.gz", "wt", encoding="utf-8", newline="") as out:
        out.write('anchor,positive,negative_1\n"gz\nx",p,"n ""q"""\n')
    found = files.read_supervised(spark, f"{csv_dir}/*_supervised.csv").where("source_file = 'd_supervised.csv'")
    assert [(r["anchor"], r["positive"], r["negative_1"]) for r in found.collect()] == [("gz\nx", "p", 'n "q"')]
    (csv_dir / "top20.csv").write_text("anchor,original_positive,best_other_positive\na1,p1,n1\na1,p1,n1\n")
    report = prepared.prepare(
        spark, f"{csv_dir}/*_supervised.csv", f"{csv_dir}/top20.csv", shared_path(spark, "early"),
        after_read=lambda: shutil.rmtree(csv_dir),
    )
    assert not csv_dir.exists()
    assert report.where("data_version = 'supervised_with_detailed'").agg(F.sum("n_detailed")).first()[0] == 2


def test_files_that_cannot_be_split_are_read_once(spark, tmp_path, small_splits):
    with gzip.open(tmp_path / "t.csv.gz", "wt", encoding="utf-8", newline="") as out:
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(
            [("anchor", "positive", "negative"), *((f"a\n{i}", "p", "n" * 90) for i in range(2000))]
        )
    found = files.read_csv_by_header(spark, f"{tmp_path}/t.csv.gz", ["anchor", "positive", "negative"])
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert sorted(r["anchor"] for r in found.collect()) == sorted(f"a\n{i}" for i in range(2000))
    with gzip.open(tmp_path / "open.csv.gz", "wt", encoding="utf-8", newline="") as out:
        out.write('anchor,positive,negative\n"a\nb",p,n\n"c\nd')
    found = files.read_csv_by_header(spark, f"{tmp_path}/open.csv.gz", ["anchor"])
    assert sorted(r["anchor"] for r in found.collect()) == ["a\nb", "c\nd"]
