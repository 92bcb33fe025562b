import math
import random
import re

from pyspark.sql import functions as F

from tablescout.operators import benchgen as BG
from tablescout.operators import catalog as C
from tablescout.operators import documents as D
from tablescout.operators import groundtruth as GT
from tablescout.operators import profile as PR
from tablescout.sources import files as S

CELLS = "table_id string, row_idx long, col_idx int, col_name string, value string"


def cells(spark, **tables):
    """tables: name -> (column names, rows)"""
    data = [
        (t, r, c, names[c], v) for t, (names, rows) in tables.items() for r, row in enumerate(rows) for c, v in enumerate(row)
    ]
    return spark.createDataFrame(data, CELLS)


def test_type_inference_scans_downwards(spark):
    columns = {
        "bool": ["true", "t", "x", "f"], "ints": ["1", "2", "3", "true", "true", "true"], "two_ints": ["1", "2", "text", ""],
        "first_wins": ["1.5", "1", "2.5", "2", "3.5", "3"], "poly": ["a", "multipolygon((1 2))", "3", "4", "5"], "blank": ["", ""],
    }
    data = [("t", r, c, n, v) for c, (n, vs) in enumerate(columns.items()) for r, v in enumerate(vs)]
    got = {r["col_idx"]: r["infer_type"] for r in PR.infer_types(spark.createDataFrame(data, CELLS)).collect()}
    assert got == {0: "BOOL", 1: "INT", 2: "Other", 3: "FLOAT", 4: "POLYGON"}


def header(spark, *names):
    return spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], "table_id string, col_idx int, col_name string")


def test_headers(spark):
    got = PR.clean_headers(header(spark, "", "a, b", "`", "x(y)", "w " * 60)).orderBy("col_idx").collect()
    assert [r["clean"] for r in got[:4]] == ["unk_1", "a. b", "unk_2", "x y"]
    assert len(got[4]["clean"]) <= 64 and got[4]["warnings"] == ["name cut"] and got[1]["warnings"] == ["comma replaced"]

    def fixed(*names):
        return [r["fixed"] for r in PR.repair_duplicates(header(spark, *names), "col_name").orderBy("col_idx").collect()]

    assert fixed("a", "b", "A", "a") == ["a", "b", "A_2", "a_3"]
    assert fixed("a", "a", "a_2", "a") == ["a", "a_3", "a_2", "a_4"]
    assert fixed(*["z"] * 100) == [None] * 100


def test_joinable_tables(spark):
    df = cells(
        spark, t1=(["City ", "year", "score"], [["Rome", "1", "5.0"], ["Oslo", "2", "7.5"]]),
        t2=(["city", "year"], [["rome ", "1"], ["Bern", "2"]]), t3=(["town"], [["Rome"]]),
    )
    captions = df.select("table_id").distinct().withColumn("caption", F.upper("table_id"))
    got = sorted(map(tuple, PR.joinable(df, captions).collect()))
    assert got == [("city", "rome", "t1", "T1"), ("city", "rome", "t2", "T2")]


def test_cells_must_meet_all_conditions_in_one_row(spark):
    df = cells(
        spark, src=(["k", "v"], [["a", "5.0"]]), hit=(["k", "v"], [["a", "x"], ["A ", "5.00"]]),
        split=(["k", "v"], [["a", "x"], ["b", "5.0"]]), other=(["k"], [["a"]]),
    )
    questions = spark.createDataFrame([("q", "src")], "question_id string, table_id string")
    cond = spark.createDataFrame([("q", 0, "K", " A", 0), ("q", 1, "v", "5.000", 0)], "question_id string, cond int, name string, value string, row_idx long")
    refs = spark.createDataFrame([("q", "k"), ("q", "v")], "question_id string, name string")
    shared = GT.schema_shared_tables(refs, GT.column_index(df.select("table_id", "col_name").distinct(), refs))
    assert {r["table_id"] for r in shared.collect()} == {"src", "hit", "split"}
    found = GT.verify_cells(questions, cond, shared, df)
    assert sorted(map(tuple, found.collect())) == [("q", "hit", 1), ("q", "src", 0)]
    assert {r["table_id"] for r in GT.final_tables(shared, found, cond).collect()} == {"hit", "src"}
    rows = GT.answer_rows(found, shared).collect()
    assert {(r["table_id"], tuple(r["rows"]), r["filter_by_cell"]) for r in rows} == {("hit", (1,), 1), ("src", (0,), 1)}


def plain_rows(sets, tables, cells):
    """Rows that meet every (name, value): by text or as equal floats."""
    out = set()
    for q, conds in sets.items():
        for t in tables[q]:
            for r in {r for a, r, *_ in cells if a == t}:
                own = [(n.lower().strip(), v.lower().strip()) for a, b, n, v in cells if (a, b) == (t, r)]
                plain = lambda v: str(float(v)) if re.fullmatch(r"-?[0-9]+\.[0-9]+", v) else v
                if all(any(n == cn and plain(cv) == plain(v) for n, v in own) for cn, cv in conds):
                    out.add((q, t, r))
    return out


def test_conditions_are_intersected_per_distinct_set(spark):
    """Many questions share a set; floats match in any notation, whole numbers only as text; a condition without a cell; one hot value."""
    rng = random.Random(9)
    values = ["1.50", "1.5", " A ", "a", "2.0", "2", "hot", "hot", "hot"]
    cells = [(f"t{t}", r, n, rng.choice(values)) for t in range(4) for r in range(12) for n in ("K", "v ", "w")]
    pool = [(("k", "1.5"),), (("k", "hot"), ("v", "a")), (("k", "2.0"), ("v", "hot"), ("w", "hot")), (("v", "2"),), (("k", "1.50"),), (("w", "nowhere"), ("k", "hot"))]
    sets = {f"q{i}": pool[i % len(pool)] for i in range(20)}
    tables = {q: [f"t{t}" for t in range(4) if rng.random() < 0.8 and t != i % 4] for i, q in enumerate(sets)}
    questions = spark.createDataFrame([(q, f"t{i % 4}") for i, q in enumerate(sets)], "question_id string, table_id string")
    cond = spark.createDataFrame([(q, f" {n.upper()}", v, -1) for q, c in sets.items() for n, v in c], "question_id string, name string, value string, row_idx long")
    shared = spark.createDataFrame([(q, t) for q, some in tables.items() for t in some] + [(q, f"t{i % 4}") for i, q in enumerate(sets)], "question_id string, table_id string")
    got = GT.verify_cells(questions, cond, shared, spark.createDataFrame(cells, "table_id string, row_idx long, col_name string, value string"))
    own = {(q, f"t{i % 4}", -1) for i, q in enumerate(sets)}
    assert sorted(map(tuple, got.collect())) == sorted(plain_rows(sets, tables, cells) | own)


def test_whole_files_need_no_folder_each(spark, tmp_path):
    """Texts with line breaks, of no letter, null, and two rows of one name; files lie in the folders of the tasks."""
    rows = [(i, f"text {i}\nöß" * (i % 3)) for i in range(40)] + [(100, None), (7, "again")]
    df = spark.createDataFrame(rows, "page long, text string").repartition(5)
    S.write_whole_files(df, str(tmp_path / "files"), "page", "text")
    got = [(int(r["path"].rsplit("/", 1)[1][:-4]), r["text"]) for r in S.read_whole_files(spark, str(tmp_path / "files"), "*.txt").collect()]
    want = {i: f"{t or ''}\n" for i, t in rows[:-1]}
    assert len(got) == 41 and sorted(dict(got)[7].split("\n")) == sorted(want[7].split("\n") + ["again"])
    assert {i: t for i, t in got if i != 7} == {i: t for i, t in want.items() if i != 7}
    assert len(list((tmp_path / "files").iterdir())) <= 8


def test_answer_lists_are_made_once_per_set(spark, monkeypatch):
    """Lists equal the rows of every question: repeated questions, one with two source tables, one hot set cut into parts, no
    answer at all; no row per question and answer row is collected."""
    cells = [(f"t{t}", r, "k", "hot" if r % 3 else f"v{r}") for t in range(3) for r in range(9)] + [("t0", None, "k", "hot")]
    asks = [(f"q{i}", "t2", "hot" if i % 4 else "v3") for i in range(20)] + [("q1", "t2", "hot"), ("two", "t0", "hot"), ("two", "t1", "hot"), ("none", "t0", "gone")]
    questions = spark.createDataFrame([a[:2] for a in asks], "question_id string, table_id string")
    cond = spark.createDataFrame([(q, "K ", v, 1) for q, _, v in asks], "question_id string, name string, value string, row_idx long")
    shared = spark.createDataFrame([(q, f"t{t}") for q in sorted({a[0] for a in asks}) for t in range(3)], "question_id string, table_id string")
    df = spark.createDataFrame(cells, "table_id string, row_idx long, col_name string, value string")
    told = lambda rows: sorted((r["question_id"], r["table_id"], tuple(r["rows"]), r["filter_by_cell"]) for r in rows)
    want = told(GT.answer_rows(GT.verify_cells(questions, cond, shared, df), shared).collect())
    assert len(want) == 20 * 3 + 3 + 1 and ("two", "t0", (1, 2, 4, 5, 7, 8), 0) in want and ("none", "t0", (1,), 2) in want
    monkeypatch.setattr(GT, "LISTED_ROWS", 7)
    got = GT.cell_answers(questions, cond, shared, df)
    assert told(got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "row_idx" not in plan
    shown = GT.cell_answers(questions, cond, shared, df, show=lambda rows: F.array_join(rows.cast("array<string>"), ","))
    assert sorted(r["rows"] for r in shown.collect()) == sorted(",".join(map(str, w[2])) for w in want)


def test_titles_are_judged_in_batches_and_asked_again(spark):
    """Lines out of order, a line left out at first, a judge that never answers one line, the source table kept."""
    pairs = [("q", f"t{i:02d}", "Red Fox", f"the red fox {i}" if i % 3 else f"the red foxes {i}") for i in range(45)]
    df = spark.createDataFrame(pairs, "question_id string, table_id string, entity string, title string")

    def moody():
        calls = []

        def ask(prompts):
            calls.append(len(prompts))
            assert all(len(p.split("\n")) <= 21 and p.startswith("Reply line by line") for p in prompts)
            plain = GT.mention_judge([p.split("\n", 1)[1] for p in prompts])
            if len(calls) == 1:
                plain = ["\n".join(["Well:", *reversed(p.split("\n")[1:])]) for p in plain]
            return ["\n".join(x for x, line in zip(p.split("\n"), ask_.split("\n")[1:]) if "foxes 3 " not in line) if len(calls) > 1 else p for p, ask_ in zip(plain, prompts)]

        return ask

    got = {r["table_id"]: r["yes"] for r in GT.judge_titles(df, moody, head="Reply line by line").collect()}
    assert got == {t: "foxes" not in title for _, t, _, title in pairs}
    silent = GT.judge_titles(df, lambda: lambda prompts: ["" for _ in prompts])
    assert all(r["yes"] is None for r in silent.collect()) and silent.count() == 45
    questions = spark.createDataFrame([("q", "t03")], "question_id string, table_id string")
    kept = GT.verify_titles(questions, df, GT.judge_titles(df.where("table_id <> 't03'"), moody, head="Reply line by line"))
    want = {t for t, yes in got.items() if yes} | {"t03"}
    assert {r["table_id"] for r in kept.collect()} == want and {r["filter_by_title"] for r in kept.collect()} == {44 - (len(want) - 1)}


def test_answers_are_read_by_their_numbers():
    assert GT.read_answers("1. x Answer: Yes; Red\n2. Answer: no; NO\nnoise\n4. Answer: maybe;\n3. Answer:yes") == {1: True, 2: False, 3: True}


def loop_batches(lengths, size):
    left = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out = []
    while left:
        out.append([left.pop(0)])
        while left and len(out[-1]) < size:
            out[-1].append(left.pop())
    return out


def test_balanced_batches_equal_the_loop(spark):
    rng = random.Random(5)
    for n, size in [(1, 4), (7, 1), (3, 9), (23, 4), (24, 4), (25, 5)]:
        lengths = [rng.randint(1, 6) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(lengths)), "id long, len int")
        got = {}
        for r in D.balanced_batches(df, "id", "len", size).orderBy("batch", "place").collect():
            got.setdefault(r["batch"], []).append(r["id"])
        assert [got[b] for b in sorted(got)] == loop_batches(lengths, size), (n, size)
        assert len(got) == math.ceil(n / size)


def test_fingerprint_ignores_row_order_but_not_field_borders(spark):
    rows = [("t1", "a", "b"), ("t1", "c", "d"), ("t2", "c", "d"), ("t2", "a", "b"), ("t3", "ab", ""), ("t3", "c", "d"), ("t4", "a", None), ("t5", "a", "")]
    df = spark.createDataFrame(rows, "t string, x string, y string")
    h = {r["t"]: r["hash"] for r in C.table_fingerprint(df, "t", ["x", "y"]).collect()}
    assert h["t1"] == h["t2"] and len({h[t] for t in ("t1", "t3", "t4", "t5")}) == 4


def test_generation_retries_with_smaller_batches(spark):
    def model():
        def ask(prompts):
            if len(prompts) > 3:
                raise MemoryError
            return [p.upper() for p in prompts]

        return ask

    df = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "id int, prompt string")
    got = D.generate(df, "prompt", "answer", model, batch=13)
    assert got.where("answer = upper(prompt)").count() == 30


def test_structures_fill_equalities_from_one_row(spark):
    names = ["city", "n", "x"]
    df = cells(spark, t=(names, [[f"c{i}", str(i), f"{i}.5"] for i in range(8)]))
    columns = header(spark, *names).join(PR.infer_types(df), PR.COLUMN).join(PR.numeric_ranges(df), PR.COLUMN, "left").select(
        *PR.COLUMN, "col_name", F.col("infer_type").isin("INT", "FLOAT").alias("numeric"), "lo", "hi", "all_int"
    )
    out = BG.fill_equalities(BG.sample_structures(columns, per_table=40), df).collect()
    assert len(out) == 40
    for r in out:
        s = r["sql_struct"]
        equal = [c for c in s["where"] if c["op"] == "="]
        assert len({c["row"] for c in equal}) <= 1
        for c in equal:
            assert c["val"] == {"city": f"c{c['row']}", "n": str(c["row"]), "x": f"{c['row']}.5"}[c["col_name"]]
        assert not {c["col"] for c in s["select"]} & {c["col"] for c in s["where"]}
        if s["having"]:
            assert s["group_by"]
    texts = [r["x"] for r in BG.fill_equalities(BG.sample_structures(columns, 40), df).select(BG.struct_text(F.col("sql_struct")).alias("x")).collect()]
    assert all(t.startswith("select ") for t in texts)


def test_row_counts_with_gaps(spark):
    data = [("t", r, c, "n", "v") for r in (0, 2, 8_589_934_592) for c in (0, 1)]
    assert [tuple(r) for r in PR.row_counts(spark.createDataFrame(data, CELLS)).collect()] == [("t", 3)]


def test_every_group_is_sampled(spark):
    df = spark.range(6000).selectExpr("id as key", "id % 2100 as by")
    got = BG.stratified_sample(df, "by", "key")
    assert got.select("by").distinct().count() == got.count() == 2100


def test_parquet_lake_of_several_schemas(spark, tmp_path):
    from tablescout.sources import files as S

    spark.range(7).selectExpr("id", "timestamp_seconds(id) at", "id * 1.50 x").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(3).selectExpr("id", "timestamp_seconds(id) at", "id * 1.50 x").coalesce(1).write.parquet(str(tmp_path / "deep" / "b"))
    spark.range(0).selectExpr("cast(id as string) only").coalesce(1).write.parquet(str(tmp_path / "c"))
    rows = S.lake_parquet_rows(spark, str(tmp_path)).withColumn("t", F.regexp_extract("table_id", r"/(\w)/part-[^/]*$", 1))
    got = sorted((r.t, r.row_idx, r.names, r.cells) for r in rows.where("row_idx < 2").collect())
    head, first = ["id", "at", "x"], ["1", "1970-01-01 00:00:01", "1.50"]
    assert [(t, i) for t, i, _, _ in got] == [("a", -1), ("a", 0), ("a", 1), ("b", -1), ("b", 0), ("b", 1), ("c", -1)]
    assert got[2][2:] == (head, first) and got[5][3] == first and got[0][2:] == (head, None) and got[6][2] == ["only"]
    assert rows.where("row_idx >= 0").count() == 10


def plain_headers(names):
    """One table's header repaired column by column."""
    keys, seen, out = {n.lower() for n in names}, {}, []
    for n in names:
        k = n.lower()
        seen[k] = seen.get(k, 0) + 1
        if seen[k] == 1:
            out.append(n)
            continue
        free, s = 0, 1
        while free < seen[k] - 1:
            s += 1
            form = (n if len(n) + len(f"_{s}") < 64 else n[: len(n) - 3]) + f"_{s}"
            free += form.lower() not in keys
        out.append(form)
    return out


def test_header_repair_skips_used_numbers(spark):
    rng = random.Random(12)
    pool = ["a", "A", "a_2", "a_3", "A_4", "a_02", "a_2_2", "a_10", "b", "B_2", "x" * 61, "x" * 58 + "_2", "X" * 61, "x" * 58 + "_10", "a_1", "_2", ""]
    tables = {f"t{i}": [rng.choice(pool) for _ in range(rng.randint(1, 40))] for i in range(30)}
    rows = [(t, i, n) for t, names in tables.items() for i, n in enumerate(names)]
    got = {}
    for r in PR.repair_duplicates(spark.createDataFrame(rows, "table_id string, col_idx int, clean string")).orderBy("table_id", "col_idx").collect():
        got.setdefault(r["table_id"], []).append(r["fixed"])
    assert got == {t: plain_headers(names) for t, names in tables.items()}


def test_a_header_of_fifty_thousand_names(spark):
    names = ["a", "A", "a", *[f"a_{i}" for i in range(2, 50_000)], *["often"] * 100]
    df = spark.createDataFrame(list(enumerate(names)), "col_idx int, clean string").withColumn("table_id", F.lit("t"))
    out = {r["col_idx"]: (r["fixed"], r["error"]) for r in PR.repair_duplicates(df).where("col_idx < 3 or clean = 'often'").collect()}
    assert [out[i][0] for i in range(3)] == ["a", "A_50000", "a_50001"]
    assert all(fixed is None and error for i, (fixed, error) in out.items() if i >= 3)


def test_rows_are_sampled_before_they_are_opened(spark):
    rows = [(t, i, ["k", "v"], [str(i), None if i % 3 else "x" * i]) for t in ("p", "q") for i in range(40)]
    df = spark.createDataFrame(rows, "table_id string, row_idx long, names array<string>, cells array<string>")
    by_rows, by_cells = PR.sampled_cells(df, 7), PR.sampled_cells(PR.opened(df), 7)
    assert sorted(map(str, by_rows.select(by_cells.columns).collect())) == sorted(map(str, by_cells.collect()))
    plan = by_rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("WindowGroupLimit")  # the explode stands above the sample
    assert PR.sampled_cells(df.where("row_idx < 0"), 7).count() == 0


def test_labels_by_a_judge(spark):
    questions = spark.createDataFrame([(1, "e1", "who?"), (2, "e2", "when?")], "question_id long, elicitation string, question string")
    contexts = spark.createDataFrame(
        [(i, f"t{i}", "e1" if i < 4 else "e2", f"context {i}") for i in range(8)] + [(9, "t1", "e1", "context 2")],
        "context_id long, table_id string, elicitation string, context string",
    )

    def judge():
        return lambda prompts: ["**Yes**, it can" if ("context 2" in p and "who?" in p) or ("context 5" in p and "when?" in p) else "No" for p in prompts]

    got = BG.judge_labels(questions, contexts, judge)
    assert sorted(map(tuple, got.collect())) == [(1, "t1"), (1, "t2"), (2, "t5")]


def test_a_call_that_leaves_answers_out_is_repeated(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(30)], "prompt string").coalesce(1)

    def model():
        return lambda prompts: [p.upper() for p in prompts] if len(prompts) <= 10 else ["too few"]

    assert sorted(r["out"] for r in D.generate(df, "prompt", "out", model).collect()) == sorted(f"P{i}" for i in range(30))


def test_schemas_of_many_small_files_come_from_one_job(spark, tmp_path, monkeypatch):
    """Files of other writers, large files and types that only Spark can tell; the same groups as Spark's own look at each file."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tablescout.sources import files as S

    for i in range(60):
        kind = {"k": pa.array([i, None], pa.int64()), "v": pa.array(["x", None])}
        if i % 3 == 1:
            kind = {"k": pa.array([1.5]), "at": pa.array([datetime.datetime(2020, 1, 2)], pa.timestamp("us")), "d": pa.array([None], pa.decimal128(9, 2))}
        if i % 3 == 2:
            kind = {"l": pa.array([[1, 2]], pa.list_(pa.int32())), "b": pa.array([b"x"]), "u": pa.array([datetime.datetime(2020, 1, 2)], pa.timestamp("us", "UTC"))}
        pq.write_table(pa.table(kind), str(tmp_path / f"f{i}.parquet"))
    pq.write_table(pa.table({"old": pa.array([datetime.datetime(2020, 1, 2)])}), str(tmp_path / "old.parquet"), use_deprecated_int96_timestamps=True)
    pq.write_table(pa.table({"w": pa.array([1], pa.uint32())}), str(tmp_path / "unsigned.parquet"))
    spark.range(3).selectExpr("id", "cast(id as decimal(5,1)) as d", "map('a', id) as m").write.parquet(str(tmp_path / "own.parquet"))

    def groups():
        return sorted((sorted(f.simpleString() for f in schema), len(paths)) for schema, paths in S.schema_groups(spark, str(tmp_path)))

    mine = groups()
    monkeypatch.setattr(S, "_footer_schema", lambda content: None)
    assert mine == groups() and sum(n for _, n in mine) >= 63
    monkeypatch.undo()
    monkeypatch.setattr(S, "FOOTER_FILE", 0)
    assert mine == groups()
    assert S.lake_parquet_rows(spark, str(tmp_path)).where("row_idx >= 0").count() == 20 * 2 + 20 + 20 + 1 + 1 + 3
