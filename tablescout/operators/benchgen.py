"""Benchmark generation: sampled question structures, their texts, checks and label spreading.

Every random choice is a hash of (seed, table, attempt, purpose), so a run can be repeated
on any cluster and a lost task draws the same values again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import text as tx
from tablescout.functions.hashing import draw, hash_rank
from tablescout.operators.documents import generate
from tablescout.operators.profile import complete_row, drawn_value, sampled_rows
from tablescout.operators.scaling import fits, salted_join, top_per_group
from tablescout.session import materialize

# Operators a question may use and the chances of its parts.
AGGREGATES = ["max", "min", "avg", "sum"]
PREDICATES = ["=", ">", "<", "between"]
HAVING_PREDICATES = [">", "<", "between"]
CHANCE = {"aggr": 0.5, "group_by": 0.2, "having": 0.8, "order_by": 0.2, "title": 0.9}
TOPS = [3, 5]

CONDITION = "struct<col:int,col_name:string,op:string,val:string,val_2:string,row:bigint>"


def sample_structures(columns: DataFrame, per_table: int = 10, seed=7) -> DataFrame:
    """Question structures without equality values.

    columns(table_id, col_idx, col_name, numeric, lo, hi, all_int) are the prompt columns of each
    table. Returns (table_id, attempt, sql_struct); `=` conditions still lack their value."""
    profile = columns.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "col_name", "numeric", "lo", "hi", "all_int"))).alias("cols")
    )
    rows = profile.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(per_table - 1)))).withColumns({
        "num": F.filter("cols", lambda c: c["numeric"]), "txt": F.filter("cols", lambda c: ~c["numeric"]),
    })

    def u(tag: str, *more: Column) -> Column:
        return draw(seed, F.col("table_id"), F.col("attempt"), F.lit(tag), *more)

    def pick(items: Column, tag: str) -> Column:
        return F.get(items, F.floor(u(tag) * F.size(items)).cast("int"))

    def choice(values: list, tag: str, *more: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.floor(u(tag, *more) * len(values)).cast("int"))

    def shuffled(items: Column, tag: str) -> Column:
        keyed = F.transform(
            items, lambda c: F.struct(hash_rank(seed, F.col("table_id"), F.col("attempt"), F.lit(tag), c["col_idx"]).alias("d"), c.alias("c"))
        )
        return F.transform(F.array_sort(keyed), lambda x: x["c"])

    def number(c: Column, tag: str) -> tuple[Column, Column]:
        a, b = u(tag + "1", c["col_idx"]), u(tag + "2", c["col_idx"])
        one = drawn_value(c["lo"], c["hi"], c["all_int"], a)
        pair = [drawn_value(c["lo"], c["hi"], c["all_int"], f(a, b)) for f in (F.least, F.greatest)]
        return one, pair

    def selected(c: Column, aggr: Column) -> Column:
        return F.struct(c["col_idx"].alias("col"), c["col_name"].alias("col_name"), aggr.alias("aggr"))

    no_aggr = F.lit(None).cast("string")
    num, txt, cols = F.col("num"), F.col("txt"), F.col("cols")
    rows = rows.withColumn("is_aggr", (F.size(num) > 0) & (u("aggr") < CHANCE["aggr"]))
    rows = rows.withColumns({
        "a1": F.when(F.col("is_aggr"), pick(num, "a1")),
        "op1": choice(AGGREGATES, "op1"),
        "g": F.when(F.col("is_aggr") & (F.size(txt) > 0) & (u("group") < CHANCE["group_by"]), pick(txt, "g")),
    })
    grouped = F.col("g").isNotNull()
    others = F.filter(num, lambda c: c["col_idx"] != F.col("a1")["col_idx"])
    rows = rows.withColumns({
        "a2": F.when(F.col("is_aggr") & ~grouped & (F.size(num) > 1) & (u("second") < 0.5), pick(others, "a2")),
        "has": grouped & (u("having") < CHANCE["having"]),
        "o": F.when(~F.col("is_aggr") & (F.size(num) > 0) & (u("order") < CHANCE["order_by"]), pick(num, "o")),
    })
    plain = F.transform(
        F.slice(shuffled(cols, "sel"), F.lit(1), F.when(u("nsel") < 0.5, 1).otherwise(2)), lambda c: selected(c, no_aggr)
    )
    aggr_select = F.array_compact(F.array(
        F.when(grouped, selected(F.col("g"), no_aggr)),
        selected(F.col("a1"), F.col("op1")),
        F.when(F.col("a2").isNotNull(), selected(F.col("a2"), choice(AGGREGATES, "op2"))),
    ))
    rows = rows.withColumn("sel", F.when(F.col("is_aggr"), aggr_select).otherwise(plain))
    loose = F.col("is_aggr") | F.col("o").isNotNull()
    n_pred = F.when(
        loose, F.when(u("npred") < 0.1, 0).when(u("npred") < 0.55, 1).otherwise(2)
    ).otherwise(F.when(u("npred") < 0.5, 1).otherwise(2))
    used = F.transform("sel", lambda s: s["col"])
    free = F.filter(shuffled(cols, "pred"), lambda c: ~F.array_contains(used, c["col_idx"]))

    def condition(c: Column) -> Column:
        op = F.when(c["numeric"], choice(PREDICATES, "op", c["col_idx"])).otherwise("=")
        one, (low, high) = number(c, "v")
        return F.struct(
            c["col_idx"].cast("int").alias("col"), c["col_name"].alias("col_name"), op.alias("op"),
            F.when(op == "between", low).when(op != "=", one).alias("val"),
            F.when(op == "between", high).alias("val_2"), F.lit(None).cast("bigint").alias("row"),
        )

    h_one, (h_low, h_high) = number(F.col("a1"), "h")
    h_op = choice(HAVING_PREDICATES, "hop")
    struct = F.struct(
        F.col("sel").alias("select"),
        F.transform(F.slice(free, F.lit(1), n_pred), condition).alias("where"),
        F.when(grouped, F.struct(F.col("g")["col_idx"].alias("col"), F.col("g")["col_name"].alias("col_name"))).alias("group_by"),
        F.when(F.col("has"), F.struct(
            F.col("a1")["col_idx"].alias("col"), F.col("a1")["col_name"].alias("col_name"), F.col("op1").alias("aggr"),
            h_op.alias("pred_op"), F.when(h_op == "between", h_low).otherwise(h_one).alias("val"),
            F.when(h_op == "between", h_high).alias("val_2"),
        )).alias("having"),
        F.when(F.col("o").isNotNull(), F.struct(
            F.col("o")["col_idx"].alias("col"), F.col("o")["col_name"].alias("col_name"),
            F.when(u("dir") < 0.5, "desc").otherwise("asc").alias("direction"),
        )).alias("order_by"),
        F.when(F.col("o").isNotNull(), F.struct(choice(TOPS, "top").alias("top"))).alias("limit"),
    )
    return rows.select("table_id", "attempt", struct.alias("sql_struct"))


def fill_equalities(structures: DataFrame, cells: DataFrame, seed=7) -> DataFrame:
    """Values of `=` conditions from one complete row per question; without such a row the
    question keeps no condition."""
    qid = F.concat_ws("#", "table_id", F.col("attempt").cast("string"))
    keyed = materialize(structures.withColumn("question_id", qid), "structures")
    needed = keyed.select("question_id", "table_id", F.explode("sql_struct.where").alias("c")).where("c.op = '='").select(
        "question_id", "table_id", F.col("c.col").alias("col_idx")
    )
    rows = complete_row(cells, needed, seed)
    values = (
        needed.join(rows, ["question_id", "table_id"]).join(cells.select("table_id", "row_idx", "col_idx", "value"), ["table_id", "row_idx", "col_idx"])
        .groupBy("question_id").agg(
            F.map_from_entries(F.collect_list(F.struct("col_idx", tx.strip(F.col("value"))))).alias("_v"),
            F.first("row_idx").alias("_row"),
        )
    )
    s = F.col("sql_struct")
    equal = F.exists(s["where"], lambda c: c["op"] == "=")
    filled = F.transform(s["where"], lambda c: F.when(
        c["op"] == "=", F.struct(
            c["col"].alias("col"), c["col_name"].alias("col_name"), c["op"].alias("op"),
            F.try_element_at("_v", c["col"]).alias("val"), c["val_2"].alias("val_2"), F.col("_row").alias("row"),
        )
    ).otherwise(c))
    where = F.when(~equal, s["where"]).when(F.col("_v").isNotNull(), filled).otherwise(F.array().cast(f"array<{CONDITION}>"))
    return keyed.join(values, "question_id", "left").withColumn("sql_struct", s.withField("where", where)).drop("_v", "_row")


def use_title(struct: Column, title: Column, seed=7) -> Column:
    """1 with chance .9 / number of columns the question touches, for a table with a title."""
    touched = F.size(F.array_distinct(F.concat(
        F.transform(struct["select"], lambda c: c["col"].cast("int")), F.transform(struct["where"], lambda c: c["col"])
    )))
    u = draw(seed, F.col("table_id"), F.col("attempt"), F.lit("title"))
    return ((tx.strip(title) != "") & (touched > 0) & (u < CHANCE["title"] / touched)).cast("int")


def struct_text(s: Column) -> Column:
    """SQL text of a question structure: columns in double quotes, values in back quotes."""
    name = lambda c: F.concat(F.lit('"'), c["col_name"], F.lit('"'))
    value = lambda v: F.concat(F.lit("`"), v, F.lit("`"))
    select = F.array_join(F.transform(s["select"], lambda c: F.when(
        c["aggr"].isNull(), name(c)
    ).otherwise(F.concat(c["aggr"], F.lit("("), name(c), F.lit(")")))), ", ")

    def compare(left: Column, op: Column, val: Column, val_2: Column) -> Column:
        return F.when(op == "between", F.concat(left, F.lit(" between "), value(val), F.lit(" and "), value(val_2))).otherwise(
            F.concat(left, F.lit(" "), op, F.lit(" "), value(val))
        )

    where = F.array_join(F.transform(s["where"], lambda c: compare(name(c), c["op"], c["val"], c["val_2"])), " and ")
    h = s["having"]
    having = compare(F.concat(h["aggr"], F.lit("("), name(h), F.lit(")")), h["pred_op"], h["val"], h["val_2"])
    return F.concat_ws(
        " ",
        F.concat(F.lit("select "), select),
        F.when(F.size(s["where"]) > 0, F.concat(F.lit("where "), where)),
        F.concat(F.lit("group by "), name(s["group_by"])),
        F.concat(F.lit("having "), having),
        F.concat(F.lit("order by "), name(s["order_by"]), F.lit(" "), s["order_by"]["direction"]),
        F.concat(F.lit("limit "), s["limit"]["top"].cast("string")),
    )


def struct_references(structures: DataFrame, types: DataFrame) -> DataFrame:
    """(table_id, attempt, ref_col_names, ref_values): normalised names of all columns a rendered structure mentions, and the
    values of its conditions on columns of no special type. types(table_id, col_idx, infer_type)."""
    s = F.col("sql_struct")
    names = F.concat(
        F.transform(s["select"], lambda c: c["col_name"]), F.transform(s["where"], lambda c: c["col_name"]),
        F.array(s["group_by"]["col_name"], s["having"]["col_name"], s["order_by"]["col_name"]),
    )
    named = structures.select(
        "table_id", "attempt", F.array_sort(F.array_distinct(F.transform(F.array_compact(names), tx.norm_text))).alias("ref_col_names"), s["where"].alias("_w")
    )
    plain = types.where("infer_type = 'Other'").select("table_id", F.col("col_idx").alias("_col"))
    values = named.select("table_id", "attempt", F.explode("_w").alias("_c")).select(
        "table_id", "attempt", F.col("_c.col").alias("_col"), tx.norm_text(F.col("_c.val")).alias("_v")
    ).join(plain, ["table_id", "_col"]).groupBy("table_id", "attempt").agg(F.array_sort(F.collect_set("_v")).alias("ref_values"))
    return named.drop("_w").join(values, ["table_id", "attempt"], "left").withColumn(
        "ref_values", F.coalesce("ref_values", F.array().cast("array<string>"))
    )


def table_prompts(table_rows: DataFrame, columns: DataFrame, captions: DataFrame, rows: int = 10, seed=0) -> DataFrame:
    """(table_id, prompt): caption, header and sampled rows of a table, ` | ` between cells.

    rows(table_id, row_idx, cells) are sampled whole and never opened into cells."""
    line = F.array_join(F.transform("cells", lambda v: F.coalesce(v, F.lit(""))), " | ")
    lines = sampled_rows(table_rows, rows, seed, "_no").select("table_id", "_no", line.alias("line"))
    body = lines.groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "line"))), lambda x: x["line"]), "\n").alias("_body")
    )
    header = columns.groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "col_name"))), lambda x: x["col_name"]), " | ").alias("_header")
    )
    caption = F.when(tx.strip("caption") != "", F.concat(F.lit("Table Caption:\n"), "caption")).otherwise("")
    return captions.join(header, "table_id").join(body, "table_id", "left").select(
        "table_id",
        F.concat(caption, F.lit("\nTable Data:\n"), "_header", F.coalesce(F.concat(F.lit("\n"), "_body"), F.lit(""))).alias("prompt"),
    )


def context_tasks(tables: DataFrame, questions: list[str], done: DataFrame) -> DataFrame:
    """(id, table_id, question_no, context_question, schema_text, n_rows) for tables without contexts yet."""
    items = F.array(*map(F.lit, questions))
    todo = tables.join(done.select("table_id").distinct(), "table_id", "left_anti")
    return todo.select("*", F.posexplode(items).alias("question_no", "context_question")).withColumn(
        "id", F.concat("table_id", F.lit("_SEP_contexts-"), F.col("question_no").cast("string"))
    )


def context_prompt(schema_text: Column, question: Column, n_rows: Column) -> Column:
    # Fixed text of the context prompt.
    return F.concat(
        F.lit("Given a dataset, consisting of "), n_rows.cast("string"), F.lit(" rows, with the following columns:\n/*\n"),
        schema_text, F.lit("\n*/\nand this question:\n/*\n"), question,
        F.lit(
            "\n*/\nAssume you are the creator of the table and have all the necessary information to respond to the "
            "question. Generate a concise answer to the question based on the table, satisfying the following criteria:\n"
            "1. Completeness: The answer must definitively and comprehensively address all parts of the question.\n"
            "2. Relevance: The answer must directly provide the information requested in the question without any "
            "extraneous details."
        ),
    )


def stratified_sample(contexts: DataFrame, by: str, key: str, total: int = 1020, seed=0) -> DataFrame:
    """total // groups contexts per elicitation question, at least one, in hash order."""
    groups = contexts.select(by).distinct().count()
    size = max(1, total // max(1, groups))
    drawn = contexts.withColumn("_d", hash_rank(seed, F.col(by), F.col(key)))
    return top_per_group(drawn, [by], [F.col("_d"), F.col(key)], size, "sample_no").drop("_d")


def spread_labels(questions: DataFrame, contexts: DataFrame, share: float = 0.5) -> DataFrame:
    """(question_id, table_id): tables whose context answers a question asked for the same elicitation question.

    The offline judge says yes when the context holds at least `share` of the question's terms.
    The terms are joined as an inverted index inside the elicitation question, so contexts sharing
    nothing with a question never meet it. questions(question_id, elicitation, terms),
    contexts(context_id, table_id, elicitation, terms)."""
    q = questions.select("question_id", "elicitation", F.array_distinct("terms").alias("_t"))
    asked = q.select("question_id", "elicitation", F.size("_t").alias("_need"), F.explode("_t").alias("term"))
    held = contexts.select("context_id", "table_id", "elicitation", F.explode(F.array_distinct("terms")).alias("term"))
    # The sampled questions are few, so contexts usually stay where they are; a larger set is salted.
    if fits(asked):
        met = held.join(F.broadcast(asked), ["elicitation", "term"])
    else:
        counts = held.groupBy("elicitation", "term").agg(F.count(F.lit(1)).alias("n"))
        met = salted_join(held, asked, counts, ["elicitation", "term"], ["context_id"])
    shared = met.groupBy("question_id", "_need", "context_id", "table_id").agg(
        F.count(F.lit(1)).alias("_have")
    )
    return shared.where(F.col("_have") >= F.col("_need") * share).select("question_id", "table_id").distinct()


def labeling_prompt(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), question,
        F.lit("\n\nCan the question be answered with the context alone? Begin your answer with yes or no."),
    )


def judge_labels(questions: DataFrame, contexts: DataFrame, judge, prompt=labeling_prompt) -> DataFrame:
    """spread_labels with a judge: every context of a question's elicitation question is shown with the question, and its
    table is an answer when the judge says yes. questions(question_id, elicitation, question),
    contexts(context_id, table_id, elicitation, context).

    `judge` is a factory of list[str] -> list[str], called once a task. Questions are a sample of bounded size and go to
    the contexts, which do not move; without that bound both are joined by salted elicitation questions."""
    if fits(questions):
        met = contexts.join(F.broadcast(questions), "elicitation")
    else:
        counts = contexts.groupBy("elicitation").agg(F.count(F.lit(1)).alias("n"))
        met = salted_join(contexts, questions, counts, ["elicitation"], ["context_id"])
    asked = met.select("question_id", "table_id", prompt(F.col("context"), F.col("question")).alias("prompt"))
    answered = generate(asked, "prompt", "answer", judge)
    return answered.where(judged_yes(F.col("answer"))).select("question_id", "table_id").distinct()


def judged_yes(answer: Column) -> Column:
    s = F.lower(tx.strip(answer))
    return s.startswith("yes") | s.startswith("**yes")


def rephrase_prompt(question: Column, far: bool = False) -> Column:
    # Fixed texts of the rephrase prompts.
    how = "completely different words (do not share any keywords)" if far else "different wordings"
    return F.concat(
        F.lit('Original Question:"'), question,
        F.lit(f'"\n\nRephrase the above question with {how}. Respond in the following format:\nRephrased Question: ...'),
    )


def echo_rephraser(prompts: list[str]) -> list[str]:
    """Offline default: gives the original question back in the asked format."""
    return ["Rephrased Question: " + p.split('"', 1)[1].rsplit('"\n\n', 1)[0] for p in prompts]


def rephrased(answer: Column) -> Column:
    """The question inside a rephrase answer; numbered answers carry theirs on the third line."""
    third = F.get(F.split(answer, "\n"), F.lit(2))
    return (
        F.when(F.contains(answer, F.lit("Rephrased Question 1")), F.substring_index(third, "Rephrased Question 1:", -1))
        .when(F.contains(answer, F.lit("Rephrased Question: ")), F.substring_index(answer, "Rephrased Question: ", -1))
        .otherwise(answer)
    )


def structure_checks(mine: str, back: str) -> dict[str, Column]:
    """Equality of both structures part by part after normalising and sorting."""
    a, b = F.col(mine), F.col(back)
    n = tx.norm_text

    def select(s):
        return F.array_sort(F.transform(s["select"], lambda c: F.struct(n(c["col_name"]).alias("c"), n(c["aggr"]).alias("a"))))

    def where(s):
        return F.array_sort(F.transform(s["where"], lambda c: F.struct(
            n(c["col_name"]).alias("c"), n(c["op"]).alias("o"), n(c["val"]).alias("v"), n(c["val_2"]).alias("w")
        )))

    def one(s, part, *fields):
        return F.when(s[part].isNotNull(), F.concat_ws("\u0001", *[n(s[part][f].cast("string")) for f in fields]))

    wa, wb = where(a), where(b)
    names = F.transform(wa, lambda c: c["c"])
    kept = F.filter(wb, lambda c: F.array_contains(names, c["c"]))
    more = F.transform(F.filter(wb, lambda c: ~F.array_contains(names, c["c"])), lambda c: c["c"])
    titled = a["use_title"] == 1
    return {
        "same_select": select(a) == select(b),
        "same_where": F.when(titled, (F.size(wa) < F.size(wb)) & (wa == kept)).otherwise(wa == wb),
        "same_group_by": one(a, "group_by", "col_name").eqNullSafe(one(b, "group_by", "col_name")),
        "same_having": one(a, "having", "col_name", "aggr", "pred_op", "val", "val_2").eqNullSafe(
            one(b, "having", "col_name", "aggr", "pred_op", "val", "val_2")
        ),
        "same_order_by": one(a, "order_by", "col_name", "direction").eqNullSafe(one(b, "order_by", "col_name", "direction")),
        "same_limit": one(a, "limit", "top").eqNullSafe(one(b, "limit", "top")),
        "more_cols": F.when(titled & (F.size(wa) < F.size(wb)) & (wa == kept), more),
    }


def compare_structures(df: DataFrame, mine: str = "sql_struct", back: str = "back_struct") -> DataFrame:
    checked = df.withColumns(structure_checks(mine, back))
    parts = ["same_select", "same_where", "same_group_by", "same_having", "same_order_by", "same_limit"]
    consistent = F.lit(True)
    for p in parts:
        consistent = consistent & F.col(p)
    # part names without "same_" of the parts that differ, in the order of a rendered structure
    different = F.array_compact(F.array(*[F.when(~F.col(p), F.lit(p[len("same_"):])) for p in parts]))
    return checked.withColumn("consistent", consistent).withColumn("differences", different)


def copied_texts(questions: DataFrame, strict: bool = True) -> DataFrame:
    """Adds `copied_cols` and `copied_cells`: names, and values of three or more words, standing in the question."""
    q = tx.collapse_ws(tx.norm_text(F.col("question")))
    inside = lambda c: tx.mentions(tx.collapse_ws(c), q, strict)
    return questions.withColumn("copied_cols", F.filter("ref_col_names", inside)).withColumn(
        "copied_cells", F.filter("ref_values", lambda c: (F.size(tx.split_ws(c)) >= 3) & inside(c))
    )


def tagged_lines(response: Column, tag: str) -> Column:
    """Array of (no, text) from lines `n. <tag> text`, numbered from 0."""
    lines = F.regexp_extract_all(response, F.lit(rf"(?m)^(\s*[0-9]+\.[^\n]*?{tag}[^\n]*)$"), F.lit(1))
    return F.transform(lines, lambda x: F.struct(
        (F.regexp_extract(x, r"^\s*([0-9]+)\.", 1).cast("int") - 1).alias("no"),
        tx.strip(F.substring_index(x, tag, -1)).alias("text"),
    ))


def bracketed(response: Column, begin: str, end: str) -> Column:
    """Array of (no, text) between `<begin>n` and `<end>n`."""
    found = F.regexp_extract_all(response, F.lit(rf"(?s)({begin}[0-9]+.*?{end}[0-9]+)"), F.lit(1))
    return F.transform(found, lambda x: F.struct(
        F.regexp_extract(x, rf"^{begin}([0-9]+)", 1).cast("int").alias("no"),
        tx.strip(F.regexp_extract(x, rf"(?s)^{begin}[0-9]+(.*?){end}[0-9]+$", 1)).alias("text"),
    ))


def entities(response: Column) -> Column:
    """Entity names from `no || name || type` lines between the two entity markers."""
    body = F.regexp_extract(response, r"(?s)Text_1_NER_BEGIN(.*?)Text_1_NER_END", 1)
    fields = F.transform(F.split(body, "\n"), lambda x: F.split(x, r"\|\|"))
    return F.transform(F.filter(fields, lambda f: F.size(f) == 3), lambda f: tx.strip(F.get(f, F.lit(1))))


def label_rows(sheet: DataFrame) -> DataFrame:
    """(question, table_id, row_idx) from a label sheet; grid rows count from 2, `ok` names no row.

    sheet(tables, question, rows): several tables and their row lists stand on separate lines."""
    pairs = F.arrays_zip(F.split("tables", "\n").alias("t"), F.split("rows", "\n").alias("r"))
    each = sheet.select("question", F.explode(pairs).alias("_p")).select(
        "question", tx.strip(F.col("_p")["t"]).alias("table_id"), F.split(tx.strip(F.col("_p")["r"]), ",").alias("_g")
    )
    grid = F.when(F.lower(F.get("_g", F.lit(0))) != "ok", F.col("_g"))
    return each.select("question", "table_id", F.explode_outer(grid).alias("_r")).select(
        "question", "table_id", (tx.strip(F.col("_r")).cast("int") - 2).alias("row_idx")
    )


def cap_rows(rows: DataFrame, table: str, row: str, labelled: Column, most: int = 10) -> DataFrame:
    """At most `most` rows per table: labelled rows first, then the original order."""
    return top_per_group(rows.withColumn("is_label", labelled), [table], [F.col("is_label").desc(), F.col(row)], most, "place")


def is_simple(sql: Column) -> Column:
    """No join, one FROM and one WHERE."""
    once = lambda word: F.size(F.split(sql, word)) == 2
    return ~F.contains(sql, F.lit(" JOIN ")) & once(" FROM ") & once(" WHERE ")


# Keys an annotation run adds.
DERIVED = ["answer_tables", "filter_by_title", "filter_by_cell"]


def reset_annotations(questions: DataFrame) -> DataFrame:
    return questions.drop(*DERIVED)


def review_sheet(questions: DataFrame) -> DataFrame:
    """Question parts with rows and columns also in spreadsheet notation."""
    q = F.col("question")
    letters = F.transform("where_cols", lambda c: tx.sheet_letters(c + 1))
    return questions.select(
        "id", "table_id", "title",
        F.when(F.substring(q, 1, 1) == "|", tx.strip(F.substring(q, 2, 1_000_000_000))).otherwise(q).alias("question"),
        F.col("row").alias("answer_row"), (F.col("row") + 2).alias("answer_row_grid"),
        F.col("sel_col").alias("answer_col"), tx.sheet_letters(F.col("sel_col") + 1).alias("answer_col_grid"),
        F.array_join(F.transform("where_cols", lambda c: c.cast("string")), " , ").alias("where_cols"),
        F.array_join(letters, " , ").alias("where_cols_grid"),
    )


def add_title_entity(questions: DataFrame, entity_list: str = "entities", key: str = "id", seed=0) -> DataFrame:
    """Adds `sample_entity`, one of the title's distinct entities by hash, and appends it to the prompt."""
    ranked = F.array_sort(F.transform(
        F.array_distinct(entity_list), lambda e: F.struct(hash_rank(seed, F.col(key), e).alias("d"), e.alias("e"))
    ))
    tail = F.concat(F.lit(" , where context : { name : null , operator : like , value : "), F.col("sample_entity"), F.lit(" }"))
    return questions.withColumn("sample_entity", F.get(ranked, F.lit(0))["e"]).withColumn(
        "sql_prompt", F.concat("sql_prompt", F.coalesce(tail, F.lit("")))
    )
