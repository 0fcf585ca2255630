import corpus_pipeline as C


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    counts = []
    for name, stage in C.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, small), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert n > counts[0] >= counts[1] >= counts[2] == counts[3] > 0.6 * n
    packed = C.STAGES[-1][1](spark, docs, small).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_copies_do_not_survive(spark):
    """Of the near duplicates among documents of good quality, one of twenty at most comes through, and no empty document."""
    path = "/root/testdata/sf0.01"
    good = C.cut(C.quality_rules(spark, C.table(spark, path, "documents"), path), "good")
    copies = C.near_dedup.near_duplicates(good, width=5).filter("NOT kept").select("doc_id")
    docs = C.cut(C.line_dedup_stage(spark, good, path), "lines")
    docs = C.cut(C.near_dedup_stage(spark, docs, path), "near")
    assert docs.join(copies, "doc_id").count() <= 0.05 * copies.count()
    assert docs.filter("trim(text) = ''").count() == 0
    clean = good.join(copies, "doc_id", "left_anti")
    assert clean.join(docs, "doc_id", "left_semi").count() >= 0.97 * clean.count()


def test_odd_rows(spark, odd, marks, tmp_path):
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, odd.limit(0)):
        for name, stage in C.STAGES[:-1]:
            found = C.cut(stage(spark, rows, str(tmp_path)), name)
            assert found.columns == rows.columns and found.count() <= rows.count()
        assert C.STAGES[-1][1](spark, rows, str(tmp_path)).count() >= rows.count()


def test_sequences_follow_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(C.mixing, "UNIT", 2)
    monkeypatch.setattr(C.packing, "SLOTS", 16)
    monkeypatch.setattr(C.packing, "WINDOW", 64)
    sizes = {"a": 1600, "b": 400, "c": 100}  # weights 4, 2 and 1 by size ** 0.5
    docs = [(f"{s}{i}", s, 5 + {"a": 300, "b": 150, "c": 20}[s] + i * 7 % 90) for s, n in sizes.items() for i in range(n)]
    rows = spark.createDataFrame([(k, "word " * n, s) for k, (_, s, n) in enumerate(docs)] + [(None, None, "a")], "doc_id long, text string, source string")
    packed = C.pack_sequences(spark, rows, None).toPandas()
    assert len(packed) == len(docs) + 1 and packed.sequence_id.nunique() == packed.sequence_id.max() + 1
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy()[1:] == g.length.cumsum().to_numpy()[:-1]).all() and g.length.sum() <= 2048
    sources = packed[packed.doc_id.notna()].sort_values("sequence_id").doc_id.map(lambda i: docs[int(i)][1]).to_numpy()
    for n in (150, 300, 450, 600):
        for source, weight in {"a": 4 / 7, "b": 2 / 7, "c": 1 / 7}.items():
            assert abs((sources[:n] == source).sum() - n * weight) <= 40  # much of one window of 64


def test_running_sums_without_one_window(spark, monkeypatch):
    from forumlake.llm import common

    monkeypatch.setattr(common, "GROUP", 3)
    counts = {k * k % 97 + 100 * (k % 7): k % 5 + 1 for k in range(90)}
    found = common.with_earlier(spark.createDataFrame(list(counts.items()), "key long, n long"), "key").collect()
    assert {r.key: r.earlier for r in found} == {k: sum(n for i, n in counts.items() if i < k) for k in counts}
