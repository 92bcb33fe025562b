import pytest
from pyspark.sql import functions as F

from tablescout.functions import text as tx
from tablescout.functions.stemming import stem_word


@pytest.mark.parametrize("word, stem", [
    ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"),
    ("gas", "gas"), ("kiwis", "kiwi"), ("agreed", "agre"), ("luxuriated", "luxuri"), ("happy", "happi"), ("enjoy", "enjoy"),
    ("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("national", "nation"), ("goodness", "good"),
    ("hopefulness", "hope"), ("skies", "sky"), ("news", "news"), ("communication", "communic"), ("tables", "tabl"),
    ("controlling", "control"), ("be", "be"), ("probate", "probat"), ("cats", "cat"), ("succeed", "succeed"),
])
def test_stems(word, stem):
    assert stem_word(word) == stem


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_analysis(spark):
    assert one(spark, tx.index_terms(F.lit("The Été of a x big_data, big-DATA!"))) == ["été", "big_data", "big", "data"]
    assert one(spark, tx.index_terms(F.lit(""))) == []


def test_cutting(spark):
    assert one(spark, tx.cut_at_word(F.lit("ab  cd ef"), 5)) == "ab cd"
    assert one(spark, tx.cut_at_word(F.lit("abcdefgh i"), 5)) == "abcde"
    assert one(spark, tx.clip_cell(F.lit("  short  "))) == "short"
    assert one(spark, tx.clean_header(F.lit(" a,b (c)  d "), F.lit(1))) == "a.b c d"
    assert one(spark, tx.clean_header(F.lit(" ` "), F.lit(3))) == "unk_3"


def test_cell_types(spark):
    want = {"true": "BOOL", "T": "BOOL", "-5": "INT", "+3": "INT", "1.50": "FLOAT", "-0.5": "FLOAT", "1.": "Other",
            "multipolygon((1.0, 2.0))": "POLYGON", "multipolygon abc": "Other", "x1": "Other"}
    df = spark.createDataFrame([(v,) for v in want], "v string")
    assert {r["v"]: r["t"] for r in df.select("v", tx.cell_type(F.col("v")).alias("t")).collect()} == want
    assert one(spark, tx.canonical_float(F.lit("5.00"))) == "5.0" and one(spark, tx.canonical_float(F.lit("5"))) is None


def test_sheet_letters(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (52,), (702,), (703,), (18278,), (18279,), (475255,)], "n int")
    assert [r["x"] for r in df.select(tx.sheet_letters(F.col("n")).alias("x")).collect()] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ", "AAAA", "AAAAA"]


def test_mentions(spark):
    def hit(needle, text, strict):
        return one(spark, tx.mentions(F.lit(needle), F.lit(text), strict))

    assert hit("b", "a (b) c", True) and hit("b", "a b c", True)
    assert not hit("a", "a b", True) and hit("a", "a b", False) and hit("b", "a b", False)
    assert not hit("b", "abc b", True) and hit("b", "abc b", False)  # strict looks at the first place only
    assert not hit("b", "abc", False)


def test_ids(spark):
    assert one(spark, tx.table_of_doc(F.lit("t_SEP_contents_SEP_row-0"))) == "t"
    assert one(spark, tx.kind_of_doc(F.lit("t_SEP_contents_SEP_row-0"))) == "content"
    assert one(spark, tx.kind_of_doc(F.lit("t_SEP_contexts-1"))) == "context"


def test_float_text_has_plain_digits(spark):
    texts = ["12345678.90", "0.00050", "5.00", "-0.0", "007.10", "5", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in df.select(tx.canonical_float(F.col("t")).alias("x")).collect()]
    assert got == ["12345678.9", "0.0005", "5.0", "0.0", "7.1", None, None]
