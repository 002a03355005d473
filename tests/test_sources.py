"""Files written and read back, and the folder for stage tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pairwright.functions.turns import seeded_hash
from pairwright.operators.ensemble import concat_sources
from pairwright.schemas import PAIR, PAIR_TEXT
from pairwright.sources.corpora import read_chat_log, read_corpus, write_corpus
from pairwright.sources.pairs import read_pairs, write_pairs
from pairwright.sources.predictions import read_preds, write_preds
from pairwright.staging import shared_folder, stage

HARD = ['quote " and ""', "comma, semi;", "line\nbreak\r\n", "back\\slash \\n \\", "é漢😀", "", None, " lead"]


@pytest.fixture
def pairs(spark):
    rows = [
        (f"id{i}", 'model "a", x', "b\\", [text, "t"], [text], [None, text], 1.0, 0.0, 0.0)
        for i, text in enumerate(HARD)
    ]
    rows.append(("soft", "", "m", [], ["x"], ["y"], 0.2, 0.3, 0.5))
    return spark.createDataFrame(rows, PAIR)


@pytest.mark.parametrize("kind,multi_line", [("csv", True), ("csv", False), ("parquet", True)])
def test_pairs_come_back(spark, pairs, tmp_path, kind, multi_line):
    path = str(tmp_path / "pairs")
    write_pairs(pairs.repartition(3), path, kind)
    back = read_pairs(spark, path, kind, multi_line=multi_line)
    assert back.schema == PAIR
    assert sorted(back.collect(), key=lambda r: r.id) == sorted(pairs.collect(), key=lambda r: r.id)


def test_foreign_csv_with_line_breaks_and_ascii_escapes(spark, tmp_path):
    file = tmp_path / "train.csv"
    header = ",".join(PAIR_TEXT.fieldNames())
    file.write_text(
        header + '\n7,"m\nx",n,"[""q\\u00e9"", null]","[""say \\""hi\\""""]","[""a\\nb""]",1,0,0\n',
        encoding="utf-8",
    )
    row = read_pairs(spark, str(file), "csv").first()
    assert row.model_a == "m\nx"
    assert row.prompt == ["qé", None]
    assert row.response_a == ['say "hi"'] and row.response_b == ["a\nb"]
    assert (row.winner_model_a, row.winner_tie) == (1.0, 0.0)


def test_fold_folders_are_pruned(spark, pairs, tmp_path):
    path = str(tmp_path / "folded")
    write_pairs(pairs.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")), path, "parquet")
    read = read_pairs(spark, path, "parquet", with_fold=True)
    assert read.count() == pairs.count()
    plan = read.where("fold != 0").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan
    assert "ReadSchema: struct<id:string>" in plan


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_corpus_comes_back(spark, tmp_path, kind):
    chat = "array<struct<role:string,content:string>>"
    rows = [("1", [("user", "q\n"), ("assistant", None)], [("user", "é")])]
    corpus = spark.createDataFrame(rows, f"row_id string, chosen {chat}, rejected {chat}")
    path = str(tmp_path / "corpus")
    write_corpus(corpus, path, kind)
    back = read_corpus(spark, path, "mine", kind, keyed=True)
    assert back.drop("corpus").collect() == corpus.collect()
    assert back.first().corpus == "mine"


def test_chat_log(spark, tmp_path):
    path = str(tmp_path / "log")
    chat = "array<struct<role:string,content:string>>"
    log = spark.createDataFrame([("m", [("user", "q")], 3)], f"model string, conversation {chat}, extra int")
    log.write.parquet(path)
    assert read_chat_log(spark, path).columns == ["row_id", "model", "conversation"]


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_files_without_keys_get_stable_ones(spark, tmp_path, kind):
    chat = "array<struct<role:string,content:string>>"
    rows = [([("user", f"q{i % 40}")], [("user", "q"), ("assistant", None)]) for i in range(120)] + [(None, [])]
    corpus = spark.createDataFrame(rows, f"chosen {chat}, rejected {chat}")
    found = []
    for parts in (1, 5):
        path = str(tmp_path / f"raw{parts}")
        corpus.repartition(parts).write.format(kind).save(path)
        found.append(sorted(tuple(r) for r in read_corpus(spark, path, "mine", kind).selectExpr("row_id", "to_json(chosen)").collect()))
    assert found[0] == found[1]
    keys = [key for key, _ in found[0]]
    assert len(set(keys)) == 121 and {key.split("-")[1] for key in keys} == {"1", "2", "3"}


def test_rows_without_keys_stop_the_job(spark):
    rows = spark.createDataFrame([(None, 1)], "row_id string, v int")
    with pytest.raises(Exception, match="row without a key"):
        rows.select(seeded_hash(1, F.col("row_id"))).collect()
    with pytest.raises(Exception, match="row without a key"):
        concat_sources(rows, rows).collect()


def test_malformed_and_reordered_files_stop_the_job(spark, pairs, tmp_path):
    header = PAIR_TEXT.fieldNames()
    fine = ["7", "m", "n", '"[""q""]"', '"[""a""]"', '"[""b""]"', "1", "0", "0"]
    cases = {
        "list": (header, [*fine[:3], '"[""q"""', *fine[4:]]),
        "number": (header, [*fine[:6], "one", "0", "0"]),
        "order": ([header[0], header[2], header[1], *header[3:]], fine),
    }
    for name, (columns, row) in cases.items():
        file = tmp_path / f"{name}.csv"
        file.write_text(",".join(columns) + "\n" + ",".join(row) + "\n")
        with pytest.raises(Exception):
            read_pairs(spark, str(file), "csv").collect()
    file = tmp_path / "bad.json"
    file.write_text('{"chosen": [\n')
    with pytest.raises(Exception):
        read_corpus(spark, str(file), "mine", "json").collect()


def test_row_keys_travel_with_pairs(spark, pairs, tmp_path):
    path = str(tmp_path / "keyed")
    write_pairs(pairs.withColumn("row_id", F.concat(F.lit("k"), "id")), path, "csv")
    back = read_pairs(spark, path, "csv", with_row_id=True)
    assert {r.row_id for r in back.collect()} == {f"k{r.id}" for r in pairs.collect()}


def test_predictions_come_back(spark, tmp_path):
    path = str(tmp_path / "preds")
    frame = spark.createDataFrame([(1, "s", 0.2, 0.3, 0.5)], "row_id int, scorer string, p_a double, p_b double, p_tie double")
    write_preds(frame, path)
    row = read_preds(spark, path).first()
    assert tuple(row) == ("1", "s", 0.2, 0.3, 0.5)


def test_unknown_kind(spark, pairs, tmp_path):
    with pytest.raises(ValueError):
        write_pairs(pairs, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        read_pairs(spark, str(tmp_path), "xml")


def session_with(master, settings, folder=None):
    context = SimpleNamespace(
        master=master, getConf=lambda: settings, getCheckpointDir=lambda: folder
    )
    return SimpleNamespace(sparkContext=context)


def test_the_shared_folder_is_the_named_one():
    named = {"spark.checkpoint.dir": "hdfs:///shared"}
    assert shared_folder(session_with("yarn", named)) == "hdfs:///shared"
    assert shared_folder(session_with("yarn", {}, "hdfs:///set")) == "hdfs:///set"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_with("yarn", {}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_with("local-cluster[2,1,1024]", {}))


def test_stage_tables_lie_under_the_shared_folder(spark):
    staged = stage(spark.range(10), "ten")
    assert staged.count() == 10
    folder = shared_folder(spark).removeprefix("file:")
    assert all(folder + "/pairwright/" in name for name in staged.inputFiles())


def test_staged_plan_is_cut(spark):
    staged = stage(spark.range(100).groupBy((F.col("id") % 3).alias("k")).count(), "cut")
    assert "HashAggregate" not in staged._jdf.queryExecution().executedPlan().toString()
