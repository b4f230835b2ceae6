"""The pipeline's rows against its stages by plain Python."""

import corpus_pipeline
import plain
from test_text_operators import check_packed

from sessionloom.llm import quality

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = quality.score_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {r["doc_id"] for r in scored.filter("score >= 0.3").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    component, _ = plain.components(texts)
    texts = {d: t for d, t in texts.items() if component[d] == d}
    content = [t.encode() for t in texts.values()]
    marks = plain.covered(content, 200)
    texts = {d: bytes(x for x, m in zip(c, mark) if not m).decode(errors="ignore") for d, c, mark in zip(texts, content, marks)}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = plain.leaks(texts, items)
    check_packed(corpus_pipeline.run(spark, SMALL).collect(), [(d, t) for d, t in texts.items() if d not in leaked])


def test_stages_keep_the_columns_and_accept_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "Some text to keep.", "en", "s", 18), (3, "Some text to keep.", "en", "s", 18),
         (None, "No id here, but a text.", None, None, 23)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SMALL).columns == docs.columns
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).count() == 4


def test_stages_judge_rows_that_share_an_id_by_their_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = quality.score_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad, good = (next(r["doc_id"] for r in scored.orderBy(order).filter(f"predicted = {p}").collect()) for p, order in ((0, "score"), (1, "doc_id")))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], docs.schema.simpleString()[7:-1])
    stages, seen = dict(corpus_pipeline.STAGES), lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for key in (None, 10**6):
        # The model is learned from labelled documents, so they stay in.
        mixed = docs.unionByName(frame([(key, text[bad]), (key, text[good])]))
        kept = stages["quality"](spark, mixed, SMALL)
        assert [t for d, t in seen(kept) if d == key] == [text[good]]
        leaked = frame([(key, item), (key, "clean")])
        assert seen(stages["decontamination"](spark, leaked, SMALL)) == [(key, "clean")]
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = frame([(7, one), (7, two), (7, two), (9, two), (3, one), (8, "x y z"), (None, "q"), (None, "r")])
    assert seen(stages["near_duplicates"](spark, rows, SMALL)) == sorted(
        [(3, one), (7, two), (8, "x y z"), (None, "q"), (None, "r")], key=str)


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["x", "score", "predicted", "held_out", "_key", "kept", "spans", "t", "id", "n", "contaminated"]
    docs = spark.createDataFrame(
        [(i, f"Some text number {i} to keep, and long enough to be one.", *(f"{name} {i}" for name in names)) for i in range(3)],
        "doc_id long, text string, " + ", ".join(f"{name} string" for name in names))
    want = sorted(map(tuple, docs.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns
        assert set(map(tuple, got.collect())) <= set(want)
    assert sorted(map(tuple, corpus_pipeline.cut_repeats(spark, docs, SMALL).collect())) == want
    assert corpus_pipeline.pack(spark, docs, SMALL).agg({"length": "sum"}).first()[0] > 0
