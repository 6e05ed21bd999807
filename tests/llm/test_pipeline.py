"""The pipeline's stages on the small tables, each checked against what it should do."""

import corpus_pipeline
from weir.llm import decontamination, ngram_join, toxicity


def test_stages(spark, sf_dir, tmp_path):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = before.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, before, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        assert set(new) <= set(old)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            model = toxicity.train(before, labels)
            assert set(new) == {r.doc_id for r in toxicity.score(before, model).collect() if r.predicted == 0}
        elif name == "line dedup":
            assert set(new) == set(old)
            assert all(set(new[k].split("\n")) <= set(old[k].split("\n")) for k in new)
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "n-gram Jaccard join":
            groups = {r.doc_id: r.group_id for r in ngram_join.ngram_join(before).collect()}
            assert set(new) == set(groups.values())
        elif name == "benchmark decontamination":
            items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(old) - set(new) >= {k for k, t in old.items() if any(x in decontamination.normal(t) for x in items)}
        else:
            assert set(new) == set(old) and all(r.lossless for r in after.collect())
        seen.append(len(new))
        before = after
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "ids", "n_pieces", "lossless"} <= set(out.columns) and out.count() > 0


def test_passages_of_other_sources_go(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(200)) + "\n" + passage, f"s{i}", "en", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = corpus_pipeline.one_of_each(spark, corpus_pipeline.drop_boilerplate(spark, docs, ""), "").collect()
    assert len(got) == 4 and all(passage not in r.text and r.n_chars == len(r.text) for r in got)


def test_stages_take_odd_rows(spark, sf_dir, tmp_path):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(None, None), (None, "free words of no harm at all"), (3, "x y z"), (3, "x y z"), (3, "other words that stand alone here"), (4, ""), (5, long), (6, long + " end")]
    fields = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, n_lines int, n_dropped int, row int, keeper int, c0 int"
    docs = spark.createDataFrame([(i, t, None, None, None, 0.5, "p", 1, 2, 3, 4, 5) for i, t in rows], fields)
    kept = []
    for part in (docs, docs.where("false")):
        before = part
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(kept)}-{i}")
            stage(spark, before, sf_dir).write.parquet(path)
            after = spark.read.parquet(path)
            assert after.columns[: len(docs.columns)] == docs.columns
            before = after
        kept.append(sorted(((r.doc_id or 0, r.text) for r in before.collect()), key=lambda r: (r[0], r[1] or "")))
        assert all(r.lossless and (r.score, r.predicted, r.n_dropped, r.keeper, r.c0) == (0.5, "p", 2, 4, 5) for r in before.collect())
    assert [(i, (t or "")[:10]) for i, t in kept[0]] == [(0, "free words"), (3, "other word"), (3, "x y z"), (4, ""), (5, "word0 word")]
    assert kept[1] == []
