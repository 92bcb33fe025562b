import json

import pytest

from tablescout import TableScout


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    (root / "inner").mkdir()
    (root / "stations.csv").write_text(
        'name,address,engine\nE5,"324 S STREET\nCHICAGO, IL",E5\nE11,"5343 N AVE ""NORTH""",E11\n'
    )
    (root / "inner" / "votes.csv").write_text("date,issue,votes\n2022-11-03,Public Safety,12\n2022-11-04,Climate,7\nbad,row\n")
    (root / "inner" / "copy.csv").write_text("date,issue,votes\n2022-11-04,Climate,7\n2022-11-03,Public Safety,12\n")
    (root / "it's.csv").write_text("price,quantity\n1.5,2\n")
    (root / "header_only.csv").write_text("a,b\n")
    (root / "notes.md").write_text("not a table")
    return root


@pytest.fixture(scope="module")
def engine(spark, lake, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    scout = TableScout(str(out / "store"), spark)
    assert json.loads(scout.setup())["status"] == "SUCCESS"
    assert json.loads(scout.setup())["status"] == "SUCCESS"
    return scout


def table_id(engine, name):
    return engine.relation("table_status").where(f"table_name = \"{name}\"").first()["id"]


def test_whole_flow(engine, lake, tmp_path):
    answer = json.loads(engine.add_tables(str(lake), "me"))
    assert answer["status"] == "SUCCESS" and answer["data"]["file_count"] == 6
    taken = {t["table_name"] for t in answer["data"]["tables"] if t}
    # Row order does not matter, so one of votes/copy is a duplicate; notes.md is no table.
    assert taken - {"votes", "copy"} == {"stations", "it's", "header_only"} and len(taken) == 4

    again = json.loads(engine.add_tables(str(lake / "stations.csv"), "me"))
    assert again["status"] == "ERROR" and "already exists" in again["message"]
    both = json.loads(engine.add_tables(str(lake / "inner"), "me", accept_duplicates=True))
    assert len([t for t in both["data"]["tables"] if t]) == 2
    assert engine.relation("table_status").count() == 5
    assert json.loads(engine.add_tables(str(lake / "nothing"), "me"))["status"] == "ERROR"
    assert json.loads(engine.add_tables(str(lake), "me", source="ftp"))["status"] == "ERROR"

    stations = table_id(engine, "stations")
    (tmp_path / "c.txt").write_text("  Fire stations of the city.\n")
    got = json.loads(engine.add_metadata(str(tmp_path / "c.txt"), stations))
    assert got["status"] == "SUCCESS" and len(got["data"]["metadata_ids"]) == 1
    (tmp_path / "m.csv").write_text(f'table_id,value\n{stations},"It\'s kept by an ""agency"""\nelsewhere.csv,lost\n')
    got = json.loads(engine.add_metadata(str(tmp_path / "m.csv")))
    assert got["data"]["file_count"] == 1 and got["data"]["rejected"] == ["unknown table elsewhere.csv"]

    done = json.loads(engine.summarize())
    assert done["status"] == "SUCCESS" and len(done["data"]["table_ids"]) == 5
    assert json.loads(engine.summarize())["data"]["table_ids"] == []
    ids = [r["id"] for r in engine.relation("table_contexts").select("id").unionByName(engine.relation("table_summaries").select("id")).collect()]
    assert len(ids) == len(set(ids))

    built = json.loads(engine.generate_index("main"))
    assert built["status"] == "SUCCESS" and len(built["data"]["table_ids"]) == 5
    assert json.loads(engine.generate_index("main"))["status"] == "ERROR"
    assert json.loads(engine.generate_index("main", reindex=True))["status"] == "SUCCESS"
    assert json.loads(engine.generate_index("none", []))["message"].startswith("No context")
    assert engine.relation("indexes").count() == 2

    found = json.loads(engine.query_index("main", ["fire stations agency", "price quantity"], k=2))
    tables = [r["retrieved_tables"] for r in found["data"]]
    assert tables[0][0] == stations and tables[1][0] == table_id(engine, "it's")
    assert json.loads(engine.query_index("main", "votes for public safety"))["data"][0]["retrieved_tables"]
    assert json.loads(engine.query_index("missing", "x"))["message"] == "Index with name missing does not exist."
    for mode in ("NONE", "LLM", "COSINE", "DIRECT_SCORE"):
        got = engine.search("main", ["fire stations agency", "price quantity"], k=2, rerank=mode).sort("query_id").collect()
        assert [r["retrieved_tables"][0] for r in got] == [stations, table_id(engine, "it's")]
    with pytest.raises(ValueError):
        engine.search("main", "x", rerank="OTHER")


def test_a_failed_fulltext_part_leaves_nothing(engine, monkeypatch):
    from tablescout import engine as module

    def fail(*args, **kwargs):
        raise RuntimeError("full disk")

    folder = f"{engine.store.root}/index"
    count = lambda: len(engine.store._fs(folder)[1].listStatus(engine.store._fs(folder)[0]))
    before, registered = count(), engine.relation("indexes").count()
    monkeypatch.setattr(module.IX, "write_fulltext", fail)
    answer = json.loads(engine.generate_index("broken"))
    assert answer["status"] == "ERROR" and "full disk" in answer["message"]
    assert count() == before and engine.relation("indexes").count() == registered


def answers(spark, at, questions):
    from tablescout.operators import indexing as IX
    from tablescout.operators import textindex as X
    from tablescout.operators import vectors as V

    asked = spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
    vectors = V.embed_column(asked, "query").select("query_id", V.unit("vector").alias("vector"))
    found = [X.text_topk(IX.text_source(spark, at), X.query_terms(asked), 6), IX.near_documents(spark, at, vectors, 6),
             IX.near_documents(spark, at, vectors, 6, share=1.0)]
    return [sorted(map(tuple, f.select("query_id", "doc_id", "score", "rank").collect())) for f in found]


def test_a_changed_index_answers_like_a_new_one(spark, tmp_path):
    """Append (with ids that are already there), delete, delete again, append a deleted id anew, merge."""
    from tablescout.operators import indexing as IX

    text = lambda i: f"station number {i} engine {'ladder ' * (i % 3)} {'hose' if i % 4 else ''}"
    rows = [(f"t{i}_SEP_contents", f"t{i % 9}", "content", text(i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, table_id string, kind string, text string")
    questions = ["ladder engine 7", "hose", "station ladder ladder", "nothing known"]

    def fresh(some):
        at = str(tmp_path / f"fresh{len(list(tmp_path.iterdir()))}")
        IX.build_index(some, at)
        return answers(spark, at, questions)

    at = str(tmp_path / "index")
    IX.build_index(docs.where("table_id < 't5'"), at)
    IX.append_index(docs.where("table_id >= 't3' and table_id < 't8'"), at)
    gone = docs.where("table_id in ('t1', 't6')")
    IX.delete_documents(spark, at, gone.select("doc_id").union(spark.createDataFrame([("unknown",)], "doc_id string")))
    left = docs.where("table_id < 't8' and table_id not in ('t1', 't6')")
    IX.delete_documents(spark, at, gone.select("doc_id"))
    IX.append_index(docs.where("table_id = 't8'"), at)
    whole = left.union(docs.where("table_id = 't8'"))
    assert answers(spark, at, questions) == fresh(whole)
    before = answers(spark, at, questions)
    IX.merge_index(spark, at)
    assert answers(spark, at, questions) == before
    assert sorted(r["doc_id"] for r in IX.stored(spark, at, "documents").collect()) == sorted(r["doc_id"] for r in whole.collect())
    IX.delete_documents(spark, at, whole.select("doc_id"))
    assert answers(spark, at, questions) == [[], [], []]


def test_public_append_remove_and_merge(engine, lake):
    everything = [r["id"] for r in engine.relation("table_status").collect()]
    votes, rest = table_id(engine, "votes"), [t for t in everything if "stations" not in t]
    assert json.loads(engine.generate_index("grown", rest))["status"] == "SUCCESS"
    ask = lambda **how: [r["retrieved_tables"] for r in engine.search("grown", ["fire stations agency", "votes public safety"], k=2, rerank="NONE", **how).sort("query_id").collect()]
    stations = table_id(engine, "stations")
    assert stations not in ask()[0]
    assert json.loads(engine.append_index("grown", [stations]))["status"] == "SUCCESS"
    assert ask()[0][0] == stations and ask(vector_share=1.0) == ask()
    assert json.loads(engine.append_index("grown", [stations]))["status"] == "ERROR"  # nothing new
    ids = {r["id"] for r in engine.relation("indexes").where("name = 'grown'").collect()}
    mapped = lambda: {r["table_id"] for r in engine.relation("index_table_mappings").collect() if r["index_id"] in ids}
    assert mapped() == set(everything)
    assert json.loads(engine.remove_from_index("grown", [votes]))["status"] == "SUCCESS"
    assert votes not in ask()[1] and mapped() == set(everything) - {votes}
    kept = ask()
    assert json.loads(engine.merge_index("grown"))["status"] == "SUCCESS" and ask() == kept
    for call in (lambda: engine.append_index("missing", rest), lambda: engine.remove_from_index("missing", rest), lambda: engine.merge_index("missing")):
        assert json.loads(call())["message"] == "Index with name missing does not exist."


def test_same_path_with_new_content_replaces_the_table(engine, lake):
    (lake / "it's.csv").write_text("price,quantity\n9.5,2\n8.5,1\n")
    assert json.loads(engine.add_tables(str(lake / "it's.csv"), "me"))["status"] == "SUCCESS"
    rows = engine.rows().where("table_id like \"%it's.csv\" and row_idx >= 0").collect()
    assert sorted(r["cells"][0] for r in rows) == ["8.5", "9.5"]
    assert engine.relation("table_status").where("table_name = \"it's\"").first()["status"] == "REGISTERED"
