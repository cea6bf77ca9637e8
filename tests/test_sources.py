from pyspark.sql import functions as F

from calamus.plans.protocol import Config, SameAuthor
from calamus.sources import corpus, names, tables
from calamus.streaming import counts


def test_read_corpus(spark, tmp_path):
    folder = tmp_path / "with_underscore"
    folder.mkdir()
    (folder / "DE001_known01.txt").write_text("﻿Een twee DRIE", encoding="utf-8")
    (folder / "DE001_stem_2.txt").write_text("vier", encoding="utf-8")
    (folder / "plain.txt").write_text("vijf", encoding="utf-8")
    got = {(r["author"], r["title"]): r["tokens"] for r in corpus.read_corpus(spark, str(folder)).collect()}
    assert got == {("DE001", "known01"): ["een", "twee", "drie"], ("DE001", "stem_2"): ["vier"], ("0", "plain"): ["vijf"]}
    assert corpus.read_corpus(spark, str(folder), text_cutoff=1).select(F.max(F.size("tokens"))).first()[0] == 1


def test_names(spark):
    f = spark.createDataFrame([("L1_18070109_Dorp_jan P. pietersz_a_4_scan.txt",), ("short_name",)], "file_name string")
    r = names.seven_fields(f).collect()
    assert len(r) == 1 and r[0]["new_name"] == "Jan p pietersz_L1_Dorp_18070109"
    g = spark.createDataFrame([("S1-1797-Haven-KLAAS-brief.txt",), ("a-b",)], "file_name string")
    assert [x["new_name"] for x in names.dash_fields(g).collect()] == ["Klaas_S1"]
    assert sorted(x["author"] for x in names.index_names(f).collect()) == ["0", "1"]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.5)], "id_i string, id_j string, d double")
    tables.write_distance_table(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t"), "\t").collect() == df.collect()
    p = spark.createDataFrame([("a", "t", "b", "u", "same_author")], "author_i string, title_i string, author_j string, title_j string, label string")
    tables.write_pairs(p, str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p"), "\t").first()["kind"] == "SADP"


def test_protocol_runs(spark, sf):
    from calamus.operators.splitting import split_authors

    docs = split_authors(corpus.records(spark.read.parquet(f"{sf}/corpus.parquet")))
    for options in ({"features": "chars", "model": "plm"}, {"sample_authors": True, "sample_features": True, "iterations": 2, "n_potential": 5, "n_actual": 3, "balanced_pairs": True}):
        v = SameAuthor(metric="minmax", n_features=100, n_dev_pairs=10, n_test_pairs=10, **options).vectorize(docs)
        got = v.predict()
        assert got.where("score < 0 or score > 1").count() == 0 and got.count() > 0
        assert v.fit().count() > 0


def test_config_is_checked():
    import pytest

    with pytest.raises(NotImplementedError):
        Config(features="syllables")
    with pytest.raises(ValueError):
        Config(metric="hamming")


def test_stream_counts(spark, tmp_path):
    rows = [(1, ["een", "twee"], "2024-01-01 10:00:00"), (1, ["een", "twee"], "2024-01-01 11:00:00"), (2, ["drie"], "2024-01-02 10:00:00"), (3, None, "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, at string").withColumn("loaded_at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = counts.read_stream(spark, str(tmp_path / "in"), "doc_id bigint, tokens array<string>, at string, loaded_at timestamp")
    counts.run_once(counts.record_counts(stream), "recs", str(tmp_path / "cp"))
    assert sorted((r["doc_id"], r["n_words"]) for r in spark.table("recs").collect()) == [(1, 2), (2, 1)]


def test_daily_totals(spark, tmp_path):
    rows = [(1, ["een", "twee"], "2024-01-01 10:00:00"), (1, ["een", "twee"], "2024-01-01 11:00:00"), (2, ["drie"], "2024-01-02 10:00:00"), (3, ["x"], "2024-01-09 10:00:00")]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, at string").withColumn("loaded_at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = counts.read_stream(spark, str(tmp_path / "in"), "doc_id bigint, tokens array<string>, at string, loaded_at timestamp")
    counts.run_once(counts.daily_totals(stream), "days", str(tmp_path / "cp"), "complete")
    assert sorted((str(r["day"])[:10], r["records"], r["words"]) for r in spark.table("days").collect()) == [("2024-01-01", 1, 2), ("2024-01-02", 1, 1), ("2024-01-09", 1, 1)]


def test_numbers_in_order(spark):
    from calamus.functions.ordering import numbered, running_sums

    df = spark.createDataFrame([(f"n{(i * 37) % 101:03}", i % 7) for i in range(101)], "name string, v int").repartition(5)
    got = sorted((r["k"], r["name"]) for r in numbered(df, "k", "name").collect())
    assert got == [(k, f"n{k:03}") for k in range(101)]
    runs = running_sums(df, F.substring("name", 1, 2), [F.col("name")], total=F.col("v"))
    rows = sorted((r["name"], r["v"], r["total"]) for r in runs.collect())
    assert all(t == sum(v for _, v, _ in rows[: i + 1]) for i, (_, _, t) in enumerate(rows))
