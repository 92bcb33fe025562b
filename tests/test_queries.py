"""Registered queries against their SQL. TABLESCOUT_PARITY=all runs every one of them."""

import os

import pytest

import parity
from tablescout.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["cat_02", "cat_03", "doc_07", "doc_09", "doc_13", "doc_14", "qry_03", "qry_04", "qry_15", "eva_03", "gen_06", "gen_18", "src_01", "src_13"]
NAMES = list(QUERIES) if os.environ.get("TABLESCOUT_PARITY") == "all" else QUICK


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, name):
    ok, note = parity.compare(spark, parity.duck(SF), name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note


def test_every_survey_operator_is_registered():
    sizes = {"src": 14, "cat": 13, "doc": 17, "idx": 9, "qry": 17, "eva": 12, "gen": 36}
    want = {f"{kind}_{i:02d}" for kind, n in sizes.items() for i in range(1, n + 1)}
    assert not want - set(QUERIES)
    assert set(ORACLES) <= set(QUERIES)
