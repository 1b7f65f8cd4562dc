"""The query language and the rewrites."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newslens.functions import text
from newslens.plans import rewrite
from newslens.plans.query import And, Filter, Near, Not, Or, QueryError, Radius, Repeat, Term, View, matches, parse, show


@pytest.mark.parametrize(
    "query, want",
    [
        ("recall or warning", "(recall OR warning)"), ("(a and b)", "a AND b"), ("a or (b and c)", "(a OR b AND c)"), ("(a or b) and c", "(a OR b) AND c"), ("((a or b))", "((a OR b))"),
        ("(a or b) c or d", "(a OR b) c OR d"), ("a or b c", "(a OR b c)"), ('"war and peace"', '"war AND peace"'), ("()", ""), ("  a  ", "a"), ("not a", "NOT a"), ("((a) (b))", "a b"),
    ],
)
def test_normalize(query, want):
    assert rewrite.normalize(query) == want


def test_build():
    assert rewrite.build("x", "France, New Zealand", "United States", "a.com") == 'x sourcelang:english ("France" OR "New Zealand") sourcecountry:unitedstates domainis:a.com'
    assert rewrite.build("x", "France") == 'x sourcelang:english "France"'
    assert rewrite.build("x", ",") == "x sourcelang:english"


def test_parse():
    assert parse('a "b c" -d') == And((Term("a"), Term("b c", True), Not(Term("d"))))
    assert parse("(a OR b c)") == And((Or((Term("a"), And((Term("b"), Term("c"))))),))
    assert parse('near10:"a b" near:1.5,-2,50km repeat3:"x"') == And((Near(10, "a b"), Radius(1.5, -2.0, 50.0, "km"), Repeat(3, "x")))
    assert parse('tone<-5 imagetag:"a b"') == And((Filter("tone", "<", "-5"), Filter("imagetag", ":", "a b")))
    assert parse("NOT a AND b") == And((Not(Term("a")), Term("b")))
    assert parse("long-term") == And((Term("long-term"),))


@pytest.mark.parametrize("query", ["", "()", "(a", "a)", "a OR b", "(a OR (b OR c))", "(OR a)", '"open'])
def test_errors(query):
    with pytest.raises(QueryError):
        parse(query)


def test_unknown_field(spark):
    with pytest.raises(QueryError):
        matches("nofield:x", View(F.col("norm")))


WORDS = st.text("abc", min_size=1, max_size=3)
ATOMS = st.one_of(
    WORDS.map(Term), WORDS.map(lambda w: Term(f"{w} x", True)), st.tuples(st.integers(1, 9), WORDS).map(lambda p: Near(p[0], f"{p[1]} y")), st.tuples(st.integers(1, 9), WORDS).map(lambda p: Repeat(*p)),
    st.tuples(st.sampled_from(["tone", "f"]), st.sampled_from("<>:"), st.integers(-5, 5)).map(lambda p: Filter(p[0], p[1], str(p[2]))),
)
CLAUSES = st.one_of(ATOMS, ATOMS.map(Not), st.lists(ATOMS, min_size=2, max_size=3).map(lambda x: Or(tuple(x))))


@settings(max_examples=200, deadline=None)
@given(st.lists(CLAUSES, min_size=1, max_size=4).map(lambda x: And(tuple(x))))
def test_show_and_parse(tree):
    assert parse(show(tree)) == tree


TEXTS = ["Chain of supply.", "Supply-chain!", "supply the long, long chain", "", None, "the the THE the", "a b a b a", "näher Größe", "of the of the"]


def found(spark, query):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string").withColumn("norm", text.norm(F.col("text")))
    return [r["id"] for r in df.where(matches(query, View(F.col("norm")))).orderBy("id").collect()]


def test_text(spark):
    assert found(spark, "chain") == [0, 1, 2]
    assert found(spark, '"supply chain"') == [1]
    assert found(spark, 'near2:"supply chain"') == [0, 1]
    assert found(spark, 'near1:"supply chain"') == [1]
    assert found(spark, 'near4:"supply chain"') == [0, 1, 2]
    assert found(spark, 'repeat4:"the"') == [5]
    assert found(spark, 'repeat2:"of the"') == [8]
    assert found(spark, "GRÖSSE") == []
    assert found(spark, "GRÖßE") == [7]
    assert found(spark, "-chain") == [3, 4, 5, 6, 7, 8]
    assert found(spark, "(chain OR b) -long") == [0, 1, 6]


def test_null_metadata(spark):
    from newslens.plans.query import number

    df = spark.createDataFrame([(1, None), (2, 5.0), (3, -5.0)], "id int, tone double")
    view = View(None, {"tone": number(F.col("tone"))})
    assert [r["id"] for r in df.where(matches("-tone>0", view)).orderBy("id").collect()] == [1, 3]
