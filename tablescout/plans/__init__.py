"""All named queries; importing the modules registers them."""

from tablescout.plans import benchgen, documents, evaluation, profiling, retrieval, sources  # noqa: F401
from tablescout.plans.registry import ORACLES, QUERIES, cast_oracle

__all__ = ["ORACLES", "QUERIES"]

# Result types that SQL infers wider than Spark: ranks and sizes are ints, counts are bigints.
for _name, _columns in {
    "idx_06": "rank", "idx_07": "rank", "qry_03": "rank", "qry_04": "rank", "qry_05": "text_rank vector_rank",
    "qry_09": "rank", "qry_11": "rank", "qry_12": "rank", "qry_13": "rank", "qry_14": "rank", "qry_15": "doc_rank rank",
    "gen_12": "attempt", "gen_13": "attempt", "gen_22": "sample_no", "gen_30": "place", "doc_06": "sample_no",
    "doc_08": "n_tokens", "doc_13": "len", "eva_06": "tie_rank", "eva_09": "run", "eva_10": "q_no", "src_10": "n_cols n_rows",
}.items():
    cast_oracle(_name, {c: "int" for c in _columns.split()})
cast_oracle("eva_03", {"alpha": "double", "hits": "bigint"})
cast_oracle("eva_05", {"hits": "bigint"})
cast_oracle("eva_08", {"n": "bigint"})
