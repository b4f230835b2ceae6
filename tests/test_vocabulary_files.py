"""Large vocabularies in parts, and dictionaries over several files."""

import json

from pyspark.sql import functions as F

from sessionloom.sources import readers, writers


def whole_text(path):
    return "".join(f.read_text() for f in sorted(path.glob("part-*")))


def test_a_large_vocabulary_is_written_and_read_in_several_tasks(spark, tmp_path):
    words = spark.range(1_000_000).select(F.concat(F.lit('w,"'), F.col("id")).alias("item"), (F.col("id") * 7 % 1_000_000).alias("item_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_vocab_json(words, str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [f for f in (tmp_path / "v").glob("part-*") if f.stat().st_size]
    assert len(parts) > 1
    found = json.loads(whole_text(tmp_path / "v"))
    assert len(found) == 1_000_000 and found['w,"3'] == 21 and list(found.values())[:3] == [0, 1, 2]
    again = readers.read_vocab(spark, str(tmp_path / "v"))
    assert again.join(words, ["item", "item_id"]).count() == 1_000_000


def test_vocabularies_of_any_layout(spark, tmp_path):
    words = {"a, \"b": 3, "{x}": 4, "c:,": 5, "": 6}
    for name, text in (("one", json.dumps(words)), ("indented", json.dumps(words, indent=2)), ("dense", json.dumps(words, separators=(",", ":")))):
        (tmp_path / name).write_text(text)
        assert {r["item"]: r["item_id"] for r in readers.read_vocab(spark, str(tmp_path / name)).collect()} == words
    writers.write_vocab_json(spark.createDataFrame([], "item string, item_id bigint"), str(tmp_path / "none"))
    assert json.loads(whole_text(tmp_path / "none")) == {} and readers.read_vocab(spark, str(tmp_path / "none")).count() == 0


def test_the_last_of_repeated_keys_counts(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    (folder / "a.json").write_text('{"x": 1,\n"y": 2}\n')
    (folder / "b.json").write_text('{"x": 3}\n')
    assert {r["item"]: r["item_id"] for r in readers.read_vocab(spark, str(folder)).collect()} == {"x": 3, "y": 2}
    texts = tmp_path / "d"
    texts.mkdir()
    (texts / "2.csv").write_text("message,label\nm,old\nm,new\n")
    (texts / "1.csv").write_text("message,label\nm,first\nn,other\n")
    assert {r["message"]: r["label"] for r in readers.read_dictionary(spark, str(texts)).collect()} == {"m": "new", "n": "other"}
