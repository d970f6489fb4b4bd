import pytest

from docgrove import Analyzer, ParseError, QueryError
from docgrove.functions.analysis import HTML, DropWords, Lower, Split, glob_pattern
from docgrove.plans.compiler import Compiler
from docgrove.functions.textquery import AllOf, AnyOf, Glob, Phrase, TextParser, Without, Word, query_terms


def parse(text):
    return TextParser(Analyzer()).parse(text)


A, B, C = Word("foo"), Word("bar"), Word("ham")


@pytest.mark.parametrize(
    "text, tree",
    [
        ("foo", A),
        ("FOO", A),
        ("foo bar", AllOf((A, B))),
        ("foo and bar", AllOf((A, B))),
        ("foo OR bar", AnyOf((A, B))),
        ("foo or bar ham", AnyOf((A, AllOf((B, C))))),
        ("(foo or bar) and ham", AllOf((AnyOf((A, B)), C))),
        ("foo and not bar", AllOf((A, Without(B)))),
        ("foo not bar", AllOf((A, Without(B)))),
        ("-bar foo", AllOf((A, Without(B)))),
        ('"foo bar"', Phrase(("foo", "bar"))),
        ("foo-bar", Phrase(("foo", "bar"))),
        ('foo -"bar ham"', AllOf((A, Without(Phrase(("bar", "ham")))))),
        ("fo*", Glob("fo*")),
        ("f?o", Glob("f?o")),
        ("foo the", A),
        ("foo and the", A),
    ],
)
def test_parses(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "the", "foo and", "and foo", "foo or", "(foo", "foo)", "(foo) bar", "-foo", "not foo", "foo and and bar", "()", "the and and"])
def test_rejects(text):
    with pytest.raises(ParseError):
        parse(text)


def test_ignored_and_terms():
    p = TextParser(Analyzer())
    tree = p.parse('foo the -bar "foo ham"')
    assert p.ignored == ["the"] and query_terms(tree) == ["foo", "foo", "ham"]


def test_globs(spark):
    from docgrove import Catalog, TextIndex

    assert glob_pattern("a?c*") == "^a.c.*$"
    c = Catalog(spark.createDataFrame([(1, "foo")], "docid long, t string"))
    c["t"] = TextIndex("t")
    assert [r[0] for r in c["t"].contains("f?o").execute().ids().collect()] == [1]
    assert c["t"].contains("*oo*").execute().ids().collect() == []  # a word can't begin with a wildcard: this is oo*
    with pytest.raises(QueryError):
        Compiler(c)._glob_leg(Glob("*x"), c["t"], 1, 1.0)
    assert c["t"].check_query("foo") and not c["t"].check_query("the")


def test_analyzers_agree(spark):
    texts = ["The Quick-Brown fox_1 é É ß x 1 y2", "", "a", "Ünï cödé ΑΒΓ 日本", "<b>Bold</b> &amp; plain <i", "t\nn\tz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for a in (Analyzer(), HTML, Analyzer(Split(), Lower(), DropWords(single=True))):
        assert [r[0] for r in df.select(a.column(df["t"])).collect()] == [a.terms(t) for t in texts]
