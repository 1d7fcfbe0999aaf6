"""The pipeline on a small table: which documents each stage keeps."""

import random

import corpus_pipeline as C


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    syllables = {"aa": "ba ko li mu", "bb": "sch ein ung tz"}
    line = "ba ko limu bako mubali kokoba limumu bako lili kobamu"
    rows = []
    for i in range(200):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[lang].split(), k=rng.randint(2, 4))) for _ in range(60)]
        rows.append([i, " ".join(words), lang])
    for i in range(10, 18):
        rows[i][1] += f"\n{line}"
    item = " ".join(rows[20][1].split()[5:25])
    rows[30][1] += f" {item}"
    rows.append([300, rows[40][1] + " once more", rows[40][2]])  # a near copy
    rows.append([301, rows[41][1], rows[41][2]])
    rows += [[302, None, "aa"], [303, "12 34", "bb"]]
    table = spark.createDataFrame([(i, t, lang, f"src{i % 3}", len(t or "")) for i, t, lang in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == table.columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    everything = {i for i, *_ in rows}
    assert everything - kept[0].keys() == {302, 303}
    assert kept[1].keys() == kept[0].keys()
    assert {i for i in kept[1] if line in kept[1][i]} == {17}
    assert kept[1].keys() - kept[2].keys() == {300, 301}
    assert kept[2].keys() - kept[3].keys() == {20, 30}
    packed = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept[3].keys()
    assert {r.doc_id for r in C.run(spark, str(tmp_path)).collect()} == kept[3].keys()


def test_language_stage_rejects_only_what_has_no_language(spark):
    """Three languages alike give scores below one half; without labels nothing is rejected."""
    rows = [(i, "ba ko li mu " * 5, "abc"[i % 3]) for i in range(60)] + [(90, "12 34", "a"), (91, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in C.language(spark, docs, "").collect()} == set(range(60))
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert C.language(spark, unlabelled, "").count() == 62


def test_missing_languages_are_filled(spark):
    rows = [(i, ("ba ko li mu " if i % 2 else "schung tzein ") * 5, None if i in (4, 7) else "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang for r in C.language(spark, docs, "").collect()} == {i: "ab"[i % 2] for i in range(60)}


def test_any_columns_and_no_rows(spark, tmp_path):
    """Columns named like those the stages use inside stay as they are, on empty tables too."""
    words = lambda i: " ".join("bakolimu"[(i * 7 + j * j) % 5:][:3] + "aeiou"[(i + j) % 5] for j in range(30))
    names = ["lang_pred", "score", "score_", "doc_", "drop_", "_doc", "_drop", "_keep", "kept", "hits", "hits_", "items", "label", "class", "n", "packed"]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in names)
    rows = [(i, words(i), "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(20)]
    rows += [(None, words(50), "a", *names), (30, "", "b", *names), (31, None, None, *names)]
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.createDataFrame(rows, schema)
    for docs, gone in ((full, {30, 31}), (full.limit(0), set())):
        before = {r.doc_id: tuple(r) for r in docs.collect()}
        for name, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(f"{tmp_path}/{name}-{len(gone)}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{len(gone)}")
            after = {r.doc_id: tuple(r) for r in docs.collect()}
            assert docs.columns == full.columns and all(before[d] == row for d, row in after.items()), name
            if name == "language":
                assert before.keys() - after.keys() == gone
        C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
