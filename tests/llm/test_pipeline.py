import corpus_pipeline as cp
import duckdb
import numpy as np
from tecflow.llm import decontaminate, language, lines, pieces, simhash

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        after = stage(spark, docs, SF)
        last = name == cp.STAGES[-1][0]
        assert last or after.columns == columns
        before, docs = docs, cp.staged(after, "test")
        seen.append(docs.count())
        if name == "language":
            gone = {r.doc_id for r in language.identified(before).where("rejected").collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - gone
        elif name == "line dedup":
            own = {r.doc_id: r for r in lines.deduplicated(before).select("doc_id", "text", "n_removed", lines.has_word("text").alias("full")).collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == {i: r.text for i, r in own.items() if r.full or not r.n_removed}
        elif name == "near copies":
            groups = simhash.near_duplicates(before).collect()
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in groups}
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontaminate.contaminated(docs, bench).count() == 0
        else:
            coder = pieces.loaded(pieces.VOCABULARY)
            assert all(coder.decode(r.piece_ids) == (r.text or "") for r in docs.collect())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * seen[0]


def test_run_equals_the_stages_and_keeps_clean_documents(spark):
    got = {r.doc_id for r in cp.run(spark, SF).collect()}
    copies = duckdb.sql(f"select doc_id from (select *, min(doc_id) over (partition by text) f from '{SF}/documents.parquet') where doc_id > f and len(string_split(text, ' ')) > 20").fetchall()
    assert copies and not got & {d for (d,) in copies}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_short_lines_of_ones_own_are_kept(spark):
    shared = "All rights reserved by the many authors of this text."
    rows = [(1, shared + "\nmilk\nbread\nsalt"), (2, shared + "\ntea\ncups\nspoons"), (3, shared), (4, "\n \n"), (5, None), (6, shared + "\nmilk\nbread")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dict(cp.STAGES)["line dedup"](spark, docs, SF).collect()}
    assert got == {1: rows[0][1], 2: "tea\ncups\nspoons", 4: "\n \n", 5: None}


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null ids and texts, repeated rows, very long texts, columns whose names the operators use."""
    rng = np.random.default_rng(1)
    draw = lambda n: " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "ra"], 3)) for _ in range(n))
    item, long = draw(40), draw(40_000)
    own = [draw(60) for _ in range(30)]
    texts = [*own, long, own[3], own[3], "", None, draw(30) + " " + item + " " + draw(30), "?!"]
    rows = [(i, t, "aa", "g", 1.0, "c") for i, t in enumerate(texts)] + [(0, own[0], "aa", "g", 1.0, "c"), (None, draw(50), None, "x", None, None), (None, None, None, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, gone string, score double, component_id string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, str(tmp_path)), "odd")
        assert name == cp.STAGES[-1][0] or docs.columns == columns
        seen.append({(r.doc_id, r.text) for r in docs.collect()})
    language_, lines_, near, clean, coded = seen
    assert language_ == {(r[0], r[1]) for r in rows} - {(33, ""), (34, None), (36, "?!"), (None, None)}
    assert lines_ == {x for x in language_ if x[0] not in (31, 32)} and near == lines_
    assert clean == {x for x in near if x[0] != 35} and coded == clean
    assert {i for i, _ in coded} == {*range(31), None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, gone string, score double, component_id string").limit(0)
    assert all(stage(spark, docs, str(tmp_path)).count() == 0 for _, stage in cp.STAGES)
