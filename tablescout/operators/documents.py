"""Tables to text documents: schemas, prompts, narrations, row samples and the corpus."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.answers import NOTHING_TO_INDEX
from tablescout.functions.hashing import hash_rank
from tablescout.functions.text import token_count
from tablescout.operators.packing import pack_blocks
from tablescout.operators.scaling import ordinal, ranked, top_per_group

LOCAL_LIMIT = 512
HOSTED_LIMIT = 8191
SCHEMA_VARIANTS = ("narrations", "concat", "none")
ROW_VARIANTS = ("sample", "all", "none")


def schema_of(df: DataFrame, table_id: str) -> DataFrame:
    """(table_id, col_idx, col_name) of a typed table from its schema alone; no data is read."""
    rows = [(table_id, i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "table_id string, col_idx int, col_name string")


def schema_concat(columns: DataFrame, separator: str = " | ", prefix: str = "") -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "col_name"))), lambda x: x["col_name"])
    return columns.groupBy("table_id").agg(
        F.concat(F.lit(prefix), F.array_join(names, separator)).alias("schema_text")
    )


def narration_prompts(columns: DataFrame, brief: str = "briefly") -> DataFrame:
    """One prompt per column, showing all columns of its table."""
    # Fixed text of the narration prompt.
    prompt = F.concat(
        F.lit("A table has the following columns:\n/*\n"), F.col("schema_text"),
        F.lit(f"\n*/\nDescribe {brief} what the "), F.col("col_name"),
        F.lit(' column represents. If not possible, simply state "No description."'),
    )
    return columns.join(schema_concat(columns), "table_id").withColumn("prompt", prompt)


def template_narrator(prompts: list[str]) -> list[str]:
    """Offline default text model: names the column a narration prompt asks for."""
    found = [re.search(r"what the (.*) column represents", p, re.S) for p in prompts]
    return [f"Values of {m.group(1)}." if m else "No description." for m in found]


def generate(
    df: DataFrame, prompt: str, output: str, model: Callable[[], Callable[[list[str]], list[str]]] | None = None,
    batch: int = 50, attempts: int = 5, wait: float = 0.0,
) -> DataFrame:
    """Adds `output`: answers of a text model to `prompt`.

    `model` is a factory called once per task. A failing call is repeated with
    a batch smaller by 10, down to one prompt, at most `attempts` times per size."""
    load = model or (lambda: template_narrator)
    schema = T.StructType(df.schema.fields + [T.StructField(output, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        size = batch
        for pdf in batches:
            prompts, answers, failed = pdf[prompt].tolist(), [], 0
            while len(answers) < len(prompts):
                part = prompts[len(answers) : len(answers) + size]
                try:
                    said = ask(part)
                    if len(said) != len(part):
                        raise ValueError(f"{len(part)} prompts got {len(said)} answers")
                    answers.extend(said)
                    failed = 0
                except Exception:
                    failed += 1
                    if size == 1 and failed >= attempts:
                        raise
                    size = max(1, size - 10)
                    time.sleep(wait)
            yield pdf.assign(**{output: answers})

    return df.mapInPandas(run, schema)


def narrations(generated: DataFrame, answer: str = "answer") -> DataFrame:
    """(table_id, col_idx, text) with text `column: narration`."""
    return generated.select(
        "table_id", "col_idx",
        F.btrim(F.concat("col_name", F.lit(": "), F.col(answer)), F.lit(" \t\n\r")).alias("text"),
    )


def narrations_by_table(narrated: DataFrame) -> DataFrame:
    return narrated.groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda x: x["text"]).alias("narrations")
    )


def sample_rows(rows: DataFrame, group: str, key: str, size: int = 5, seed=0) -> DataFrame:
    """min(size, n) rows per group in a reproducible random order."""
    ranked = rows.withColumn("_draw", hash_rank(seed, F.col(key)))
    return top_per_group(ranked, [group], [F.col("_draw"), F.col(key)], size, "sample_no").drop("_draw")


def row_texts(cells: DataFrame, separator: str = " | ", null_text: str = "") -> DataFrame:
    """(table_id, row_idx, text) from cells: `col: value | col: value`; a group is one row's cells."""
    part = F.struct(
        "col_idx", F.concat("col_name", F.lit(": "), F.coalesce("value", F.lit(null_text))).alias("text")
    )
    return cells.groupBy("table_id", "row_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), separator).alias("text")
    )


def narration_blocks(narrated: DataFrame, limit: int = LOCAL_LIMIT) -> DataFrame:
    return pack_blocks(narrated, ["table_id"], "col_idx", "text", token_count(F.col("text")), limit, " || ")


def row_blocks(samples: DataFrame, limit: int = LOCAL_LIMIT, order: str = "sample_no") -> DataFrame:
    return pack_blocks(samples, ["table_id"], order, "text", token_count(F.col("text")), limit, " || ")


def merge_contexts(
    contexts: DataFrame, order: str = "id", limit: int = LOCAL_LIMIT, separator: str = " | ", source: str | None = None
) -> DataFrame:
    return pack_blocks(
        contexts, ["table_id"], order, "text", token_count(F.col("text")), limit, separator, source=source
    )


def resplit_schema(summaries: DataFrame, limit: int = LOCAL_LIMIT, table: str = "table_id", text: str = "summary") -> DataFrame:
    """A schema summary cut at ` | ` and packed again; every block names its source."""
    pieces = summaries.select(
        table, F.concat(F.col(table).cast("string"), F.lit("_SEP_contents_SEP_schema")).alias("source_id"),
        F.posexplode(F.split(text, r" \| ")).alias("piece_no", "text"),
    )
    packed = pack_blocks(
        pieces, [table], "piece_no", "text", token_count(F.col("text")), limit, " | ", source="source_id"
    )
    return packed.withColumn("source_ids", F.array_distinct("source_ids"))


def balanced_batches(prompts: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """Adds (batch, place): the longest prompt of each batch with the size-1 shortest left."""
    placed = ranked(prompts, [], [F.col(length).desc(), F.col(key)], "_r", size="_n")
    n = F.col("_n")
    heads = F.ceil(n / F.lit(size))
    r, rest = F.col("_r"), max(1, size - 1)
    from_end = n - 1 - r
    return placed.select(
        *prompts.columns,
        F.when(r < heads, r).otherwise(F.floor(from_end / F.lit(rest))).cast("long").alias("batch"),
        F.when(r < heads, F.lit(0)).otherwise(from_end % rest + 1).cast("long").alias("place"),
    )


# Fixed texts between table and ordinal in a document id.
DOC_PARTS = {
    "schema": "_SEP_contents_SEP_schema-",
    "row": "_SEP_contents_SEP_row-",
    "context": "_SEP_contexts-",
}


def document_id(table: Column, kind: Column, number: Column) -> Column:
    middle = (
        F.when(kind == "schema", DOC_PARTS["schema"]).when(kind == "row", DOC_PARTS["row"]).otherwise(DOC_PARTS["context"])
    )
    return F.concat(table, middle, number.cast("string"))


def assemble_corpus(parts: DataFrame, order: str = "block") -> DataFrame:
    """(doc_id, table_id, kind, ordinal, text), numbered from 0 per table and kind."""
    numbered = ordinal(parts, "ordinal", ["table_id", "kind"], order)
    return numbered.select(
        document_id(F.col("table_id"), F.col("kind"), F.col("ordinal")).alias("doc_id"),
        "table_id", "kind", "ordinal", "text",
    )


def select_variant(branches: dict[tuple[str, str], DataFrame], schema: str, rows: str, contexts: bool) -> DataFrame:
    """Union of the chosen schema, row and context branches."""
    if schema not in SCHEMA_VARIANTS or rows not in ROW_VARIANTS:
        raise ValueError(f"unknown variant {schema}/{rows}")
    if schema == "none" and rows == "none":
        raise ValueError("choose schema contents, row contents or both")
    chosen = [("schema", schema), ("row", rows)] + ([("context", "contexts")] if contexts else [])
    picked = [branches[c].withColumn("kind", F.lit(c[0])) for c in chosen if c[1] != "none"]
    out = picked[0]
    for part in picked[1:]:
        out = out.unionByName(part)
    return out


def require_documents(corpus: DataFrame) -> DataFrame:
    if corpus.isEmpty():
        raise ValueError(NOTHING_TO_INDEX)
    return corpus
