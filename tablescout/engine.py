"""Public API: register a lake, describe its tables, index the descriptions, find tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions import answers as A
from tablescout.functions.text import strip, token_count
from tablescout.operators import catalog as C
from tablescout.operators import documents as D
from tablescout.operators import indexing as IX
from tablescout.operators import retrieve as R
from tablescout.operators import textindex as X
from tablescout.operators import vectors as V
from tablescout.operators.judges import overlap_judge
from tablescout.operators.packing import pack_blocks
from tablescout.operators.store import Store
from tablescout.session import build_session
from tablescout.sources import files as S

LOCATIONS = "table_id string, batch string"


def _envelope(status: str, message: str, data=None) -> str:
    return json.dumps({"status": status, "message": message, "data": data})


class TableScout:
    """Six calls over one catalog folder; every call returns a JSON envelope.

    Model hooks: `narrator` and `judge` are factories of list[str] -> list[str], `embed`
    maps list[str] to a matrix. The offline defaults need no model."""

    def __init__(
        self, out_path: str, spark: SparkSession | None = None, narrator: Callable | None = None,
        embed: Callable | None = None, judge: Callable | None = None, block_tokens: int = D.LOCAL_LIMIT,
        dim: int = 64, stem: bool = True, rerank_embed: Callable | None = None,
    ):
        self.spark = spark or build_session()
        self.store = Store(self.spark, out_path)
        self.narrator, self.judge = narrator, judge or (lambda: overlap_judge)
        self.embed, self.block_tokens, self.dim, self.stem = embed, block_tokens, dim, stem
        self.rerank_embed = rerank_embed or embed

    # ---- catalog ------------------------------------------------------------------------------

    def relation(self, name: str) -> DataFrame:
        return self.store.read(f"catalog/{name}", C.RELATIONS[name])

    def _locations(self) -> DataFrame:
        return self.store.read("catalog/locations", LOCATIONS)

    def setup(self) -> str:
        for name, empty in C.empty_relations(self.spark).items():
            if not self.store.has(f"catalog/{name}"):
                self.store.write(f"catalog/{name}", empty)
        if not self.store.has("catalog/locations"):
            self.store.write("catalog/locations", self.spark.createDataFrame([], LOCATIONS))
        return _envelope("SUCCESS", A.INITIALIZED)

    def _last_id(self) -> int:
        parts = [self.relation(n).select("id") for n in ("table_contexts", "table_summaries", "indexes")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.max("id")).first()[0] or 0

    def rows(self, table_ids: DataFrame | None = None) -> DataFrame:
        """Rows of registered tables, each from the batch that registered it last; row -1 is the header."""
        folder = f"{self.store.root}/rows"
        if not self.store.exists(folder):
            return self.spark.createDataFrame([], S.ROW_SCHEMA)
        every = self.spark.read.schema(S.ROW_SCHEMA + ", batch string").parquet(folder)
        current = self._locations()
        if table_ids is not None:
            current = current.join(table_ids.select(F.col("id").alias("table_id")), "table_id", "left_semi")
        return every.join(current, ["table_id", "batch"], "left_semi").drop("batch")

    # ---- registration -------------------------------------------------------------------------

    def add_tables(
        self, path: str, creator: str, source: str = "file", s3_region: str | None = None,
        s3_access_key: str | None = None, s3_secret_access_key: str | None = None, accept_duplicates: bool = False,
    ) -> str:
        if source not in ("file", "s3"):
            return _envelope("ERROR", A.INVALID_SOURCE)
        if source == "s3":
            conf = self.spark._jsc.hadoopConfiguration()
            for key, value in (
                ("endpoint.region", s3_region), ("access.key", s3_access_key), ("secret.key", s3_secret_access_key),
            ):
                if value:
                    conf.set(f"fs.s3a.{key}", value)
        if not self.store.exists(path):
            return _envelope("ERROR", A.INVALID_PATH.format(path=path))
        one = self.store.is_file(path)
        files = S.file_outcomes(S.list_files(self.spark, path))
        batch = uuid.uuid4().hex
        target = f"{self.store.root}/rows/batch={batch}"
        S.lake_rows(self.spark, path).write.parquet(target)
        rows = self.spark.read.schema(S.ROW_SCHEMA).parquet(target)
        content = F.concat_ws("\u0001", F.to_json("names"), F.to_json(F.struct("cells")))  # the header counts too
        hashes = C.table_fingerprint(rows.select("table_id", content.alias("content")), "table_id", ["content"])
        good = files.where("accepted").select("id", "table_name").join(
            hashes.withColumnRenamed("table_id", "id"), "id", "left"
        ).withColumn("hash", F.coalesce("hash", F.concat(F.lit("empty "), "id")))
        status = self.relation("table_status")
        judged = C.split_duplicates(good, status, accept=accept_duplicates)
        outcome_path = f"{self.store.root}/outcomes/{batch}"
        files.join(judged.select("id", "hash", F.col("accepted").alias("new"), "same_as"), "id", "left").write.parquet(outcome_path)
        outcomes = self.spark.read.parquet(outcome_path)
        new = outcomes.where("new").select("id", "table_name", "hash")
        incoming = new.select(
            "id", "table_name", F.lit(C.REGISTERED).alias("status"), F.current_timestamp().alias("time_created"),
            F.lit(creator).alias("creator"), "hash",
        )
        located = new.select(F.col("id").alias("table_id"), F.lit(batch).alias("batch"))
        self.store.write("catalog/locations", C.upsert(self._locations(), located, "table_id"))
        self.store.write("catalog/table_status", C.upsert(status, incoming))
        # The answer lists catalog rows, one per file, as the API promises.
        listed = [r.asDict() for r in outcomes.select("id", "table_name", "new", "same_as", "reason").toLocalIterator()]
        tables = [{"table_id": r["id"], "table_name": r["table_name"]} if r["new"] else None for r in listed]
        if one:
            r = listed[0]
            if r["new"]:
                return _envelope("SUCCESS", A.TABLE_ADDED.format(id=r['id']), tables[0])
            return _envelope("ERROR", r["reason"] or A.TABLE_EXISTS.format(id=r['same_as']))
        return _envelope(
            "SUCCESS", A.FILES_PROCESSED.format(n=len(listed), path=path),
            {"file_count": len(listed), "tables": tables},
        )

    def add_metadata(self, metadata_path: str, table_id: str = "") -> str:
        if not self.store.exists(metadata_path):
            return _envelope("ERROR", A.INVALID_PATH.format(path=metadata_path))
        if self.store.is_file(metadata_path) and not metadata_path.endswith((".txt", ".csv")):
            return _envelope("ERROR", A.INVALID_METADATA_FILE)
        found = S.read_metadata_folder(self.spark, metadata_path, table_id)
        checked = C.check_references(found.select("table_id", "value"), self.relation("table_status"))
        staged = f"{self.store.root}/metadata/{uuid.uuid4().hex}"
        checked.withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
        checked = self.spark.read.parquet(staged)
        added = C.assign_ids(checked.where("accepted"), self._last_id(), "_at").select("id", "table_id", "context")
        contexts = self.relation("table_contexts")
        before = contexts.agg(F.max("id")).first()[0] or 0
        self.store.write("catalog/table_contexts", contexts.unionByName(added))
        ids = [r["id"] for r in self.relation("table_contexts").where(F.col("id") > before).select("id").sort("id").toLocalIterator()]
        refused = [r["reason"] for r in checked.where("not accepted").select("reason").distinct().toLocalIterator()]
        if not ids and refused:
            return _envelope("ERROR", "; ".join(refused))
        return _envelope(
            "SUCCESS", A.METADATA_ADDED.format(n=len(ids)),
            {"file_count": len(ids), "metadata_ids": ids, "rejected": refused},
        )

    # ---- summaries ----------------------------------------------------------------------------

    def summarize(self, table_id: str | None = None) -> str:
        status = self.relation("table_status")
        wanted = C.unsummarised(C.pending(status, table_id or None), status).select("id")
        table_ids = [r["id"] for r in wanted.toLocalIterator()]
        if not table_ids:
            return _envelope("SUCCESS", A.NOTHING_TO_SUMMARIZE, {"table_ids": []})
        rows = self.rows(wanted)
        columns = rows.groupBy("table_id").agg(F.first("names").alias("names")).select(
            "table_id", F.posexplode("names").alias("col_idx", "col_name")
        )
        told = D.narrations(D.generate(D.narration_prompts(columns), "prompt", "answer", self.narrator))
        keyed = rows.where("row_idx >= 0").withColumn("key", F.col("row_idx").cast("string"))
        picked = D.sample_rows(keyed.select("table_id", "key"), "table_id", "key")
        cell = F.transform(
            F.arrays_zip("names", "cells"), lambda c: F.concat(c["names"], F.lit(": "), F.coalesce(c["cells"], F.lit("")))
        )
        samples = keyed.join(picked, ["table_id", "key"]).select("table_id", "sample_no", strip(F.array_join(cell, " | ")).alias("text"))
        parts = [
            (C.COLUMN_NARRATION, D.narration_blocks(told, self.block_tokens)),
            (C.ROW_SAMPLE, D.row_blocks(samples, self.block_tokens)),
        ]
        blocks = [
            df.select("table_id", "block", C.payload(F.col("text")).alias("summary"), F.lit(kind).alias("summary_type"))
            for kind, df in parts
        ]
        staged = f"{self.store.root}/summaries/{uuid.uuid4().hex}"
        blocks[0].unionByName(blocks[1]).repartitionByRange("table_id", "summary_type", "block").sortWithinPartitions(
            "table_id", "summary_type", "block"
        ).write.parquet(staged)
        numbered = self.spark.read.parquet(staged).withColumn("_at", F.monotonically_increasing_id())
        numbered.write.parquet(f"{staged}-numbered")
        added = C.assign_ids(self.spark.read.parquet(f"{staged}-numbered"), self._last_id(), "_at").select(
            "id", "table_id", "summary", "summary_type"
        )
        old = self.relation("table_summaries")
        kept = old.join(wanted.select(F.col("id").alias("table_id")), "table_id", "left_anti").select(old.columns)
        self.store.write("catalog/table_summaries", kept.unionByName(added))
        done = self.relation("table_summaries").join(wanted.select(F.col("id").alias("table_id")), "table_id", "left_semi")
        ids = [r["id"] for r in done.select("id").sort("id").toLocalIterator()]
        if not ids:
            return _envelope("ERROR", A.SUMMARIZATION_FAILED)
        self.store.write("catalog/table_status", C.mark(status, done.select(F.col("table_id").alias("id"))))
        return _envelope(
            "SUCCESS", A.SUMMARIES_ADDED.format(n=len(ids), ids=', '.join(map(str, ids))),
            {"table_ids": table_ids, "summary_ids": ids},
        )

    # ---- index --------------------------------------------------------------------------------

    def corpus(self, tables: DataFrame) -> DataFrame:
        """Narration blocks, row blocks and merged contexts of the given tables as numbered documents."""
        body = lambda c: F.get_json_object(c, "$.payload")
        summaries = self.relation("table_summaries").join(tables, "table_id", "left_semi").select(
            "table_id", F.when(F.col("summary_type") == C.COLUMN_NARRATION, "schema").otherwise("row").alias("kind"),
            F.col("id").alias("block"), body("summary").alias("text"),
        )
        contexts = self.relation("table_contexts").join(tables, "table_id", "left_semi").select(
            "table_id", "id", body("context").alias("text")
        )
        merged = pack_blocks(contexts, ["table_id"], "id", "text", token_count(F.col("text")), self.block_tokens, " | ")
        parts = summaries.unionByName(merged.select("table_id", F.lit("context").alias("kind"), "block", "text"))
        return D.assemble_corpus(parts)

    def generate_index(self, index_name: str, table_ids: list[str] | tuple[str, ...] | None = None, reindex: bool = False) -> str:
        """Vector and full-text parts are written aside; the registry row comes last, so a failed
        build leaves no index behind."""
        registry = self.relation("indexes")
        taken = registry.where(F.col("name") == index_name).count() > 0
        if taken and not reindex:
            return _envelope("ERROR", A.INDEX_EXISTS.format(name=index_name))
        if table_ids is None:
            tables = self.relation("table_status").select(F.col("id").alias("table_id"))
        else:
            tables = self.spark.createDataFrame([(t,) for t in table_ids], "table_id string")
        location = f"{self.store.root}/index/{uuid.uuid4().hex}"
        try:
            IX.build_index(D.require_documents(self.corpus(tables)), location, self.embed, self.stem, self.dim)
        except Exception as e:
            if self.store.exists(location):
                self.store.drop(location)
            return _envelope("ERROR", str(e))
        last = self._last_id()
        ids = [last + 1, last + 2]
        fresh = self.spark.createDataFrame(
            [(ids[0], index_name, f"{location}/vectors"), (ids[1], index_name, location)], C.RELATIONS["indexes"]
        )
        mappings = self.relation("index_table_mappings")
        self.store.write("catalog/index_table_mappings", mappings.unionByName(C.map_tables(tables, ids)))
        self.store.write("catalog/indexes", registry.where(F.col("name") != index_name).unionByName(fresh))
        names = [r["table_id"] for r in tables.toLocalIterator()]
        return _envelope(
            "SUCCESS",
            A.INDEX_CREATED.format(name=index_name, vector_id=ids[0], text_id=ids[1], n=len(names)),
            {"table_ids": names, "vector_index_id": ids[0], "fulltext_index_id": ids[1]},
        )

    def _map_tables(self, index_name: str, tables: DataFrame) -> None:
        ids = [r["id"] for r in self.relation("indexes").where(F.col("name") == index_name).select("id").collect()]  # two parts
        mappings = self.relation("index_table_mappings")
        fresh = C.map_tables(tables, ids).join(mappings, ["index_id", "table_id"], "left_anti").select(mappings.columns)
        self.store.write("catalog/index_table_mappings", mappings.unionByName(fresh))

    def append_index(self, index_name: str, table_ids: list[str] | tuple[str, ...]) -> str:
        """Adds the documents of more tables, or new documents of tables already there, as a segment of the index."""
        tables = self.spark.createDataFrame([(t,) for t in table_ids], "table_id string")
        try:
            at = self.location(index_name)
            fresh = self.corpus(tables).join(IX.stored(self.spark, at, "documents").select("doc_id"), "doc_id", "left_anti")
            IX.append_index(D.require_documents(fresh), at, self.embed, self.stem, self.dim)
        except KeyError as e:
            return _envelope("ERROR", e.args[0])
        except Exception as e:
            return _envelope("ERROR", str(e))
        self._map_tables(index_name, tables)
        return _envelope("SUCCESS", f"Index {index_name} now also covers {len(table_ids)} tables.", {"table_ids": list(table_ids)})

    def remove_from_index(self, index_name: str, table_ids: list[str] | tuple[str, ...]) -> str:
        """Takes all documents of the tables out of the index; its statistics change as in a new build."""
        tables = self.spark.createDataFrame([(t,) for t in table_ids], "table_id string")
        try:
            at = self.location(index_name)
        except KeyError as e:
            return _envelope("ERROR", e.args[0])
        IX.delete_documents(self.spark, at, IX.stored(self.spark, at, "documents").join(tables, "table_id", "left_semi").select("doc_id"))
        mappings = self.relation("index_table_mappings")
        own = self.relation("indexes").where(F.col("name") == index_name).select(F.col("id").alias("index_id"))
        gone = own.crossJoin(F.broadcast(tables))  # two index parts times the asked tables
        self.store.write("catalog/index_table_mappings", mappings.join(gone, ["index_id", "table_id"], "left_anti").select(mappings.columns))
        return _envelope("SUCCESS", f"Index {index_name} no longer covers {len(table_ids)} tables.", {"table_ids": list(table_ids)})

    def merge_index(self, index_name: str) -> str:
        """Rewrites the index as one segment of its live documents."""
        try:
            IX.merge_index(self.spark, self.location(index_name), self.embed, self.stem, self.dim)
        except KeyError as e:
            return _envelope("ERROR", e.args[0])
        return _envelope("SUCCESS", f"Index {index_name} has been merged.")

    # ---- search -------------------------------------------------------------------------------

    def location(self, index_name: str) -> str:
        row = self.relation("indexes").where((F.col("name") == index_name) & ~F.col("location").endswith("/vectors")).first()
        if row is None:
            raise KeyError(A.INDEX_UNKNOWN.format(name=index_name))
        return row["location"]

    def search(
        self, index_name: str, queries: str | list[str] | DataFrame, k: int = 1, n: int = 5, alpha: float = 0.5,
        rerank: bool | str = True, vector_share: float | None = None,
    ) -> DataFrame:
        """(query_id, query, retrieved_tables) for a whole batch of questions.

        `vector_share` asks the vector part approximately: only the pivot lists nearest to a question, up to that share
        of all vectors (None: all of them).

        `rerank` is NONE, LLM (the judge hook), COSINE (the second embedding hook) or DIRECT_SCORE (shared
        terms); True and False stand for LLM and NONE."""
        at = self.location(index_name)
        asked = R.as_queries(self.spark, queries)
        embedded = V.embed_column(asked, "query", self.embed, self.dim).select("query_id", V.unit("vector").alias("vector"))
        vectors = IX.stored(self.spark, at, "vectors")
        near = None if vector_share is None else IX.near_documents(self.spark, at, embedded, k * n, vector_share)
        ranked = R.hybrid_search(
            IX.text_source(self.spark, at), X.query_terms(asked, stem=self.stem), embedded, vectors, k, n, alpha, near
        )
        docs = IX.stored(self.spark, at, "documents").select("doc_id", "table_id", "kind", "text")
        found = docs.join(ranked, "doc_id").join(asked, "query_id")
        mode = {True: "LLM", False: "NONE"}.get(rerank, rerank)
        if mode == "LLM":
            kind = F.when(F.col("kind") == "context", "context").otherwise("content")
            prompts = found.withColumn("prompt", R.relevance_prompt(kind, F.col("text"), F.col("query"))).drop("text")
            judged = D.generate(prompts, "prompt", "verdict", self.judge)
            found = R.rerank(judged, mode, relevant=R.says_yes(F.col("verdict")))
        elif mode == "COSINE":
            texts = V.embed_column(found, "text", self.rerank_embed, self.dim).withColumnRenamed("vector", "text_vector")
            pairs = V.embed_column(texts, "query", self.rerank_embed, self.dim)
            found = R.rerank(pairs, mode, score=V.cosine("vector", "text_vector"))
        elif mode == "DIRECT_SCORE":
            texts = X.analyze(found, "text", stem=self.stem).withColumnRenamed("terms", "text_terms")
            pairs = X.analyze(texts, "query", stem=self.stem)
            found = R.rerank(pairs, mode, score=R.overlap_score(F.col("terms"), F.col("text_terms")))
        else:
            found = R.rerank(found, mode)
        return R.nest_results(R.tables_of(found, k, F.col("table_id")), asked)

    def query_index(self, index_name: str, queries: str | list[str], k: int = 1, n: int = 5, alpha: float = 0.5) -> str:
        try:
            found = self.search(index_name, queries, k, n, alpha)
        except KeyError as e:
            return _envelope("ERROR", e.args[0])
        data = [
            {"query": r["query"], "retrieved_tables": r["retrieved_tables"]}
            for r in found.sort("query_id").toLocalIterator()
        ]
        return _envelope("SUCCESS", A.QUERIES_ANSWERED.format(name=index_name), data)
