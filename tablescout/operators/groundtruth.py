"""Which tables and rows answer a generated question."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.text import canonical_float, norm_text
from tablescout.operators.scaling import ranked, salted_join, small_side
from tablescout.session import materialize, text_batches


def referenced_columns(questions: DataFrame, struct: str = "sql_struct") -> DataFrame:
    """(question_id, name): distinct normalised columns of select, where, group, having and order."""
    s = F.col(struct)
    names = F.concat(
        F.transform(F.coalesce(s["select"], F.array()), lambda c: c["col_name"]),
        F.transform(F.coalesce(s["where"], F.array()), lambda c: c["col_name"]),
        F.array(s["group_by"]["col_name"], s["having"]["col_name"], s["order_by"]["col_name"]),
    )
    clean = F.array_distinct(F.transform(F.array_compact(names), norm_text))
    return questions.select("question_id", F.explode(clean).alias("name"))


def column_index(columns: DataFrame, names: DataFrame) -> DataFrame:
    """(name, table_id) of tables having a referenced column; one row per pair instead of a list."""
    wanted = small_side(names.select("name").distinct())
    return (
        columns.select(norm_text(F.col("col_name")).alias("name"), "table_id").where("name <> ''")
        .join(wanted, "name", "left_semi").distinct()
    )


def schema_shared_tables(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(question_id, table_id) of tables holding every column a question refers to.

    Questions asking for the same columns are answered once: the division runs per
    distinct column set and is then joined back."""
    sets = refs.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "\u0001").alias("_set"))
    distinct_sets = sets.groupBy("_set").agg(F.count(F.lit(1)).alias("n"))
    parts = distinct_sets.select("_set", F.explode(F.split("_set", "\u0001")).alias("name"))
    need = F.size(F.split("_set", "\u0001"))
    answers = (
        parts.join(index, "name").groupBy("_set", "table_id").agg(F.count(F.lit(1)).alias("_have"))
        .where(F.col("_have") == need).select("_set", "table_id")
    )
    return salted_join(sets, answers, distinct_sets, ["_set"], ["question_id"]).select("question_id", "table_id")


def compared(value: Column) -> Column:
    """What is compared of a normalised value: its canonical float if it is one, else the text itself."""
    return F.coalesce(canonical_float(value), value)


def condition_sets(conditions: DataFrame) -> DataFrame:
    """(question_id, set): the distinct equality conditions of a question as one sorted text; questions with the same
    conditions share it. conditions(question_id, name, value)."""
    probe = F.concat(norm_text(F.col("name")), F.lit("\u0001"), compared(norm_text(F.col("value"))))
    return conditions.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set(probe)), "\u0002").alias("set"))


def rows_meeting(sets: DataFrame, candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """(set, table_id, row_idx): rows of candidate tables that meet all conditions of a set, once per distinct set.

    candidates(set, table_id). Cells of other tables or columns are left out before conditions are looked at. The rarest
    condition of a set gives the first rows, and every further one only keeps some of them."""
    asked = sets.select("set").distinct().withColumn("probe", F.explode(F.split("set", "\u0002")))
    probes = asked.select("probe", F.split("probe", "\u0001")[0].alias("name")).distinct()
    homes = candidates.join(asked.select("set", F.split("probe", "\u0001")[0].alias("name")), "set").select("table_id", "name").distinct()
    named = cells.select("table_id", "row_idx", norm_text(F.col("col_name")).alias("name"), norm_text(F.col("value")).alias("t"))
    named = named.join(small_side(homes), ["table_id", "name"], "left_semi")
    opened = named.select("table_id", "row_idx", F.concat("name", F.lit("\u0001"), compared(F.col("t"))).alias("probe"))
    hits = materialize(opened.join(small_side(probes.select("probe")), "probe", "left_semi").distinct(), "matching-cells")
    counts = materialize(hits.groupBy("probe").agg(F.count(F.lit(1)).alias("n")), "matching-counts")
    # A set with a condition that no cell meets has no rows; the others start from their rarest condition.
    order = asked.join(counts, "probe").groupBy("set").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "probe"))), lambda c: c["probe"]).alias("rest")
    ).where(F.size("rest") == F.size(F.split("set", "\u0002")))
    order = materialize(order, "condition-order")
    most = order.agg(F.max(F.size("rest"))).first()[0] or 0
    first = order.select("set", F.col("rest")[0].alias("probe"), F.expr("slice(rest, 2, size(rest))").alias("rest"))
    rows = salted_join(hits, first, counts, ["probe"], ["table_id", "row_idx"]).select("set", "table_id", "row_idx", "rest")
    rows = rows.join(candidates.select("set", "table_id").distinct(), ["set", "table_id"], "left_semi")
    done = []
    for _ in range(1, most):
        rows = materialize(rows, "condition-rows")
        done.append(rows.where(F.size("rest") == 0))
        going = rows.where(F.size("rest") > 0).select("set", "table_id", "row_idx", F.col("rest")[0].alias("probe"), F.expr("slice(rest, 2, size(rest))").alias("rest"))
        rows = going.join(hits, ["table_id", "row_idx", "probe"], "left_semi").select("set", "table_id", "row_idx", "rest")
    return reduce(DataFrame.unionByName, [*done, rows]).select("set", "table_id", "row_idx")


def condition_answers(
    questions: DataFrame, conditions: DataFrame, shared: DataFrame, cells: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked, found, own): asked(question_id, set, table_id), the tables besides its source that a question looks into;
    found(set, table_id, row_idx), rows meeting all conditions of a set, once per distinct set; own(question_id, table_id,
    row_idx), the source rows, which belong to the answer as they are.

    questions(question_id, table_id) names the source table; conditions(question_id, name, value, row_idx) its equality
    conditions with the source row of each; shared the candidate tables."""
    sets = materialize(condition_sets(conditions), "condition-sets")
    others = shared.join(
        questions.select("question_id", F.col("table_id").alias("_src")), "question_id"
    ).where("table_id <> _src").join(sets, "question_id").select("question_id", "set", "table_id")
    others = materialize(others, "condition-tables")
    found = materialize(rows_meeting(sets, others.select("set", "table_id").distinct(), cells), "set-rows")
    own = conditions.join(questions, "question_id").select("question_id", "table_id", "row_idx").distinct()
    return others, found, own


def verify_cells(questions: DataFrame, conditions: DataFrame, shared: DataFrame, cells: DataFrame) -> DataFrame:
    """(question_id, table_id, row_idx): rows meeting every equality condition of a question; parameters as for
    condition_answers. One row per question and answer row: cell_answers gives the same as lists, which are made once per
    distinct set."""
    others, found, own = condition_answers(questions, conditions, shared, cells)
    asking = others.groupBy("set", "table_id").agg(F.count(F.lit(1)).alias("n"))
    met = salted_join(others, found, asking, ["set", "table_id"], ["question_id"]).select("question_id", "table_id", "row_idx")
    return met.unionByName(own)


LISTED_ROWS = 20_000_000


def cell_answers(questions: DataFrame, conditions: DataFrame, shared: DataFrame, cells: DataFrame, show=lambda rows: rows) -> DataFrame:
    """(question_id, table_id, rows, filter_by_cell): answer_rows of verify_cells, with `show` of the ascending rows.

    The rows of a table are listed and shown once per distinct set of conditions and then handed to its questions, so that
    only keys and one list per set and table move. What is handed out is as long as the answers are, which for
    questions over a growing table is the product of both; it is cut into tasks of about LISTED_ROWS rows."""
    asked, found, own = condition_answers(questions, conditions, shared, cells)
    pair, home = ["question_id", "table_id"], ["set", "table_id"]
    listed = lambda df, by: df.groupBy(*by).agg(F.sort_array(F.collect_set("row_idx")).alias("rows"))
    lists = materialize(listed(found, home), "set-lists")
    sizes = lists.select(*home, F.size("rows").alias("_rows"))
    met = materialize(asked.distinct().join(sizes.select(*home), home), "set-questions")
    own = materialize(listed(own, pair), "own-rows")
    count = lambda df, name: df.groupBy("question_id").agg(F.count(F.lit(1)).alias(name))
    kept = count(met.select(*pair).unionByName(own.select(*pair)).distinct(), "_kept")
    removed = kept.join(count(shared, "_before"), "question_id").select("question_id", (F.col("_before") - F.col("_kept")).alias("filter_by_cell"))
    alone = met.join(own.select(*pair), pair, "left_anti")
    load = alone.groupBy(*home).agg(F.count(F.lit(1)).alias("_asks")).join(sizes, home)
    load = load.withColumn("_load", F.col("_asks").cast("double") * F.col("_rows"))
    load = load.withColumn("_salts", F.greatest(F.lit(1), F.least(F.ceil(F.col("_load") / LISTED_ROWS), "_asks")).cast("int"))
    load = materialize(load.select(*home, "_load", "_salts"), "set-load")
    total = load.agg(F.sum("_load")).first()[0] or 0
    parts = max(questions.sparkSession.sparkContext.defaultParallelism, int(-(-2 * total // LISTED_ROWS)))
    at = alone.join(removed, "question_id", "left").join(load, home).withColumn("_salt", F.pmod(F.xxhash64("question_id"), F.col("_salts")).cast("int"))
    each = lists.join(load, home).select(*home, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), show(F.col("rows")).alias("rows"))
    out = ["question_id", "table_id", "rows", "filter_by_cell"]
    dealt = at.repartition(parts, *home, "_salt").join(each, [*home, "_salt"]).select(*out)
    # A source table of a question that is also looked into, when a question has several.
    both = met.join(own.withColumnRenamed("rows", "_own"), pair).join(lists, home)
    both = both.select(*pair, show(F.sort_array(F.array_union("rows", "_own"))).alias("rows"))
    rest = own.join(met, pair, "left_anti").select(*pair, show(F.col("rows")).alias("rows"))
    return dealt.unionByName(both.unionByName(rest).join(removed, "question_id", "left").select(*out))


def answer_rows(answers: DataFrame, shared: DataFrame) -> DataFrame:
    """(question_id, table_id, rows, filter_by_cell): the answer rows of each answer table in ascending order, and how many
    shared tables of the question the cell check removed."""
    rows = answers.groupBy("question_id", "table_id").agg(F.sort_array(F.collect_set("row_idx")).alias("rows"))
    kept = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("_kept"))
    before = shared.groupBy("question_id").agg(F.count(F.lit(1)).alias("_before"))
    removed = kept.join(before, "question_id").select("question_id", (F.col("_before") - F.col("_kept")).alias("filter_by_cell"))
    return rows.join(removed, "question_id", "left")


def title_batches(pairs: DataFrame, order: list[str], size: int = 20) -> DataFrame:
    """Adds `batch`: candidate tables of a question in groups of `size` prompts."""
    placed = ranked(pairs, ["question_id"], [F.col(c) for c in order], "_pos")
    return placed.withColumn("batch", F.floor(F.col("_pos") / F.lit(size)).cast("long")).drop("_pos")


# Fixed text of the entity question, of its answers and of their separators.
ENTITY_QUESTION = "Is ` {entity} ` mentioned in the sentence ` {title} ` ? Extract the mentioned entity from the sentence or report NO."
ANSWER_TAG = "Answer:"
_LINE = re.compile(r"\s*(\d+)\..*?" + ANSWER_TAG + r"([^;]*)")
_ASKED = re.compile(r"(\d+)\. " + re.escape(ENTITY_QUESTION).replace(r"\{entity\}", "(.*?)").replace(r"\{title\}", "(.*?)") + "$", re.S)


def title_prompt(entity: Column, title: Column) -> Column:
    head, middle, tail = re.split(r"\{entity\}|\{title\}", ENTITY_QUESTION)
    return F.concat(F.lit(head), entity, F.lit(middle), title, F.lit(tail))


def mention_judge(prompts: list[str]) -> list[str]:
    """Offline default of the title judge: an entity is mentioned when its words stand in the title one after the other."""
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    out = []
    for prompt in prompts:
        lines = []
        for part in re.split(r"\n(?=\d+\. )", prompt):
            m = _ASKED.fullmatch(part)
            if m:
                yes = f" {words(m.group(2))} " in f" {words(m.group(3))} " and words(m.group(2)) != ""
                lines.append(f"{m.group(1)}. {ANSWER_TAG} {'yes' if yes else 'no'}; {m.group(2) if yes else 'NO'}")
        out.append("\n".join(lines))
    return out


def read_answers(answer: str) -> dict[int, bool]:
    """Line number -> yes or no of a judge's answer; lines without both are passed over."""
    found = {}
    for line in answer.split("\n"):
        m = _LINE.match(line)
        word = m.group(2).strip().lower() if m else ""
        if word in ("yes", "no"):
            found[int(m.group(1))] = word == "yes"
    return found


def judge_titles(pairs: DataFrame, judge=None, size: int = 20, attempts: int = 3, head: str = "") -> DataFrame:
    """(question_id, table_id, batch, yes): the judge's answer for every pair(question_id, table_id, entity, title).

    Pairs of a question are asked `size` to a call, as numbered lines; answers come back by their numbers. Lines
    without an answer are asked again in a call of their own, up to `attempts` times, and are then null. `judge` is a
    factory of list[str] -> list[str], called once a task."""
    text_batches(pairs.sparkSession)
    load = judge or (lambda: mention_judge)
    batched = title_batches(pairs, ["table_id"], size)
    kind = {c: pairs.schema[c].dataType for c in ("question_id", "table_id")}
    line = F.struct(F.col("table_id").alias("table_id"), title_prompt(F.col("entity"), F.col("title")).alias("line"))
    calls = batched.groupBy("question_id", "batch").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # `size` lines at most
    schema = T.StructType([
        T.StructField("question_id", kind["question_id"]), T.StructField("table_id", kind["table_id"]),
        T.StructField("batch", T.LongType()), T.StructField("yes", T.BooleanType()),
    ])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for frame in frames:
            waiting = [[(i, x["table_id"], x["line"]) for x in lines] for i, lines in enumerate(frame["lines"])]
            said: dict[tuple, bool] = {}
            for _ in range(attempts):
                open_ = [(c, [x for x in call if x[:2] not in said]) for c, call in enumerate(waiting)]
                open_ = [(c, call) for c, call in open_ if call]
                if not open_:
                    break
                prompts = ["\n".join([*([head] if head else []), *(f"{n}. {x[2]}" for n, x in enumerate(call, 1))]) for _, call in open_]
                answers = ask(prompts)
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(prompts)} calls gave {len(answers)} answers")
                for (_, call), answer in zip(open_, answers):
                    for n, yes in read_answers(answer).items():
                        if 1 <= n <= len(call):
                            said[call[n - 1][:2]] = yes
            rows = [(frame["question_id"].iloc[i], t, frame["batch"].iloc[i], said.get((i, t))) for call in waiting for i, t, _ in call]
            yield pd.DataFrame(rows, columns=["question_id", "table_id", "batch", "yes"])

    return calls.mapInPandas(run, schema)


def verify_titles(questions: DataFrame, shared: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(question_id, table_id, filter_by_title): the source table as it is, and other shared tables for which more than half
    of the answers are yes; how many tables the check removed. questions(question_id, table_id) names the source."""
    asked = shared.select("question_id", "table_id").join(questions.select("question_id", F.col("table_id").alias("_src")), "question_id")
    kept = majority(verdicts.where("yes is not null"), F.col("yes")).select("question_id", "table_id")
    others = asked.where("table_id <> _src").select("question_id", "table_id")
    good = others.join(kept, ["question_id", "table_id"], "left_semi")
    count = lambda df, name: df.groupBy("question_id").agg(F.count(F.lit(1)).alias(name))
    removed = count(others, "_all").join(count(good, "_good"), "question_id", "left").select(
        "question_id", (F.col("_all") - F.coalesce("_good", F.lit(0))).alias("filter_by_title")
    )
    return questions.select("question_id", "table_id").unionByName(good).join(removed, "question_id", "left").withColumn(
        "filter_by_title", F.coalesce("filter_by_title", F.lit(0)).cast("long")
    )


def majority(verdicts: DataFrame, answer: Column) -> DataFrame:
    """(question_id, table_id) kept when more than half of the answers are yes."""
    return verdicts.groupBy("question_id", "table_id").agg(F.avg(answer.cast("int")).alias("share")).where("share > 0.5")


def missing_columns(refs: DataFrame, columns: DataFrame) -> DataFrame:
    """(question_id, name) referenced but not in the question's table. refs(question_id, table_id, name)."""
    have = columns.select("table_id", norm_text(F.col("col_name")).alias("name"))
    return refs.join(have, ["table_id", "name"], "left_anti").select("question_id", "name")


def valid_questions(questions: DataFrame, refs: DataFrame, columns: DataFrame) -> DataFrame:
    return questions.join(missing_columns(refs, columns).select("question_id").distinct(), "question_id", "left_anti")


def final_tables(shared: DataFrame, answers: DataFrame, conditions: DataFrame) -> DataFrame:
    """(question_id, table_id): verified tables where a question has equality conditions, else the shared ones."""
    checked = conditions.select("question_id").distinct()
    return answers.select("question_id", "table_id").distinct().unionByName(
        shared.join(checked, "question_id", "left_anti").select("question_id", "table_id")
    )
