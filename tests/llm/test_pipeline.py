"""The pipeline on a small table, stage by stage."""

import random

import corpus_pipeline
from siltstone.llm import op6_pii

from .test_operators import prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    item = prose(40, rng)
    rows = []
    for i in range(200):
        text = prose(90, rng)
        if i % 5 == 0:
            text = " ".join(f"{w}###" for w in text.split())
        elif i % 7 == 0:
            text = rows[0][1] if i == 7 else text + f" write to a{i}@b.org"
        elif i % 11 == 0:
            text += " " + item
        rows.append((i, text, "en", "s", len(text)))
    rows += [(300, rows[1][1], "en", "s", 1), (301, None, None, None, None), (1, rows[1][1], "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(160) if i != 7], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    clean = {i for i in range(200) if i % 5 and i % 7 and i % 11}
    assert clean <= ids["quality"] and len(ids["quality"] & set(range(0, 200, 5))) <= 2
    assert 300 not in ids["near_duplicates"] and clean <= ids["near_duplicates"]
    assert seen["near_duplicates"].where("doc_id = 1").count() == 1
    assert not any(i % 11 == 0 and i % 5 and i % 7 for i in ids["decontamination"] if i < 200) and clean <= ids["decontamination"]
    assert seen["personal_data"].where("text like '%@b.org%'").count() == 0 and op6_pii.find(seen["personal_data"]).where("size(findings) > 0").count() == 0
    assert ids["packing"] == ids["personal_data"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["packing"]


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, kind=KIND, items=(), labels=()):
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, kind)
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs


def test_decontamination_cuts_passages_of_long_documents(spark, tmp_path):
    rng = random.Random(9)
    item, before, after = prose(60, rng), prose(900, rng), prose(900, rng)
    part = " ".join(item.split()[5:35])
    rows = [(1, f"{before} {part} {after}", "en", "s", 7), (2, before, "en", "s", 7), (3, f"{part} end", "en", "s", 7), (4, None, None, None, None), (5, f"{before} {item} {after}", "en", "s", 7)]
    docs = tables(spark, tmp_path, rows, items=[(1, item)])
    got = {r.doc_id: r for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 4} and got[2].text == before and got[2].n_chars == 7 and got[4].text is None
    assert got[1].text.split() == f"{before} {after}".split() and got[1].n_chars == len(got[1].text)


def test_near_duplicates_takes_shingles_of_five_words(spark, tmp_path):
    rows = []
    for first, n in ((1, 44), (3, 60)):  # one word differs: 37 of 45 shingles of four words are shared, 35 of 45 of five; 51 of 61 of five
        words = [f"w{first}x{i}" for i in range(n)]
        rows += [(first, " ".join(words), "en", "s", 1), (first + 1, " ".join([*words[:20], "other", *words[21:]]), "en", "s", 1)]
    docs = tables(spark, tmp_path, rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 2, 3]


def test_near_duplicates_removes_rows_not_ids(spark, tmp_path):
    rng = random.Random(10)
    a, b, c, d = (prose(60, rng) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (4, d + " more"), (None, a), (None, None), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], KIND)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    wanted = [(1, a), (2, b), (3, c), (3, d), (None, a), (None, None), (5, None), (6, "")]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_columns_of_operators_names_come_back(spark, tmp_path):
    rng = random.Random(11)
    clash = "score predicted held_out hit items n_words n_hit whole contaminated findings _text_key text_key doc gone class".split()
    rows = [(i, prose(50, rng) + " mail a@b.org" * (i % 2), 9, *[f"{c}{i}" for c in clash]) for i in range(40)]
    kind = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    docs = tables(spark, tmp_path, rows, kind, [(1, prose(20, rng))], [(i, int(i > 1), 0) for i in range(40)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "n_chars", *clash], name
        for r in docs.collect():
            assert tuple(r[c] for c in clash) == rows[r.doc_id][3:], name
    assert docs.count() > 30 and corpus_pipeline.packing(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.count()


def test_empty_and_long(spark, tmp_path):
    empty, full = tmp_path / "empty", tmp_path / "full"
    tables(spark, empty, [])
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    rng = random.Random(12)
    long = prose(60_000, rng)
    tables(spark, full, [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", 1), (None, None, None, None, None), *((i, prose(30, rng), "en", "s", 1) for i in range(10, 30))], items=[(1, prose(20, rng))], labels=[(i, 1, 0) for i in range(30)])
    got = corpus_pipeline.run(spark, str(full)).collect()
    assert {r.doc_id for r in got} == {1, None, *range(10, 30)} and sum(r.length for r in got if r.doc_id == 1) > 4096
    assert all(len(r.ids) == 4 * r.length for r in got)
