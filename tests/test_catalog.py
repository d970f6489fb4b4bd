import math

import pytest

from docgrove import FWSCAN, Catalog, Cosine, FacetIndex, FieldIndex, KeywordIndex, MultipleResults, Name, NoResults, Not, NotAll, Or, RangeValue, ResultSet, TextIndex, Unsortable
from docgrove.operators import nodes as N


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        (1, 6, ["a", "b"], ["price:low:sale", "color:red"], "The quick brown fox"),
        (2, 30, ["b", "c"], ["price:low"], "the brown fox jumped over the lazy dog"),
        (3, 30, ["c"], ["price:high", "size:odd"], "folks and foo fox"),
        (4, None, None, None, None),
        (5, 94, [], [], ""),
    ]
    c = Catalog(spark.createDataFrame(rows, "docid long, v int, k array<string>, f array<string>, t string"))
    c["v"], c["k"], c["t"] = FieldIndex("v"), KeywordIndex("k"), TextIndex("t")
    c["cos"] = TextIndex("t", ranker=Cosine())
    c["f"] = FacetIndex("f", ["price", "price:low", "price:low:sale", "price:high", "color", "color:red"])
    return c


def ids(result):  # of a result set
    return sorted(r[0] for r in result.ids().collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("v == 30", [2, 3]),
        ("v != 30", [1, 4, 5]),
        ("v > 6", [2, 3, 5]),
        ("v >= 6", [1, 2, 3, 5]),
        ("v < 30", [1]),
        ("v <= 30", [1, 2, 3]),
        ("6 < v <= 94", [2, 3, 5]),
        ("not (v > 6)", [1]),
        ("not (6 < v <= 94)", [1, 4]),
        ("v in any([6, 94])", [1, 5]),
        ("v not in any([6, 94])", [2, 3, 4]),
        ("v in any([])", []),
        ("k == 'b'", [1, 2]),
        ("k != 'b'", [3, 4]),
        ("k in any(['a', 'c'])", [1, 2, 3]),
        ("k not in any(['a', 'c'])", [4]),
        ("k in all(['b', 'c'])", [2]),
        ("k not in all(['b', 'c'])", [1, 3, 4]),
        ("k in all([])", []),
        ("'b' in k", [1, 2]),
        ("f == 'price'", [1, 2, 3]),
        ("f == 'size:odd'", []),
        ("f != 'price:low'", [3, 4]),
        ("'fox' in t", [1, 2, 3]),
        ("'fox' not in t", [4, 5]),
        ("'fox -dog' in t and v < 30", [1]),
        ("v == 6 or v == 94 | 0", None),
        ("v == -6", []),
        ("not (v == 30 and k == 'c')", [1, 4, 5]),
        ("v == low", [2, 3]),
    ],
)
def test_expressions(catalog, text, expected):
    if expected is None:
        with pytest.raises(ValueError):
            catalog.parse(text)
    else:
        assert ids(catalog.execute(text, names={"low": 30})) == expected


@pytest.mark.parametrize("text", ["v", "v = 1", "v == 1; v == 2", "1 == v", "v < 1 < 2 < 3", "v in some([1])", "v in any(1, 2)", "f(v)", "5 > v > 1", "v is 1", "v and 1"])
def test_bad_expressions(catalog, text):
    with pytest.raises(ValueError):
        catalog.parse(text)


def test_unknown_names(catalog):
    with pytest.raises(NameError):
        catalog.parse("nope == 1")
    with pytest.raises(NameError):
        catalog.execute("v == missing")
    assert catalog.parse("v in any([x, 2])").bound({"x": 1}).value == [1, 2]


def test_trees(catalog):
    v, k = catalog["v"], catalog["k"]
    q = v.eq(30) & (k.eq("b") | k.eq("c")) & v.gt(1)
    assert len(q.queries) == 3 and ids(q.execute()) == [2, 3]
    assert q.negate() == Or(v.noteq(30), k.noteq("b") & k.noteq("c"), v.le(1))
    assert Not(Not(q)).negate().negate() == q or ids(Not(Not(q)).execute()) == [2, 3]
    assert ids(NotAll(k, ["b", "c"]).execute()) == [1, 3, 4]
    assert "v == 30" in q.tree() and q.tree().startswith("And")
    with pytest.raises(TypeError):
        v.eq(1) & 5
    with pytest.raises(ValueError):
        N.And().execute()
    with pytest.raises(ValueError):
        v.eq(None).execute()
    with pytest.raises(TypeError):
        catalog.execute(N.All(v, [1]))


def test_open_ranges_keep_value_holders(catalog):
    assert ids(catalog["v"].inrange(None, None).execute()) == [1, 2, 3, 5]
    assert ids(catalog["v"].notinrange(None, None).execute()) == [4]


def okapi(tf, length, df, n=4, total=13):
    mean = total / n
    return math.log(1 + n / df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))


def test_scores(catalog):
    # words kept: quick brown fox | brown fox jumped over lazy dog | folks foo fox | (none); 4 texts, 12 words
    def score(*terms, length):
        return sum(okapi(1, length, df, 4, 12) for df in terms) / sum(2.2 * math.log(1 + 4 / df) for df in terms)

    got = {r[0]: r[1] for r in catalog["t"].contains("brown fox").execute().scores().collect()}
    assert got == pytest.approx({1: score(2, 3, length=3), 2: score(2, 3, length=6)})
    # a glob's words sum, and its weight isn't known: not divided
    got = {r[0]: r[1] for r in catalog["t"].contains("fo*").execute().scores().collect()}
    assert got == pytest.approx({1: okapi(1, 3, 3, 4, 12), 2: okapi(1, 6, 3, 4, 12), 3: okapi(1, 3, 3, 4, 12) + 2 * okapi(1, 3, 1, 4, 12)})
    assert ids(catalog["t"].contains('"fox brown"').execute()) == []
    assert ids(catalog["t"].contains("brown-fox").execute()) == [1, 2]
    got = {r[0]: r[1] for r in catalog["cos"].contains("quick fox").execute().scores().collect()}
    a, b = math.log(1 + 4), math.log(1 + 4 / 3)
    assert got == pytest.approx({1: (a + b) / math.sqrt(3) / math.hypot(a, b)})


def test_sets_weigh_one_beside_scores(catalog):
    alone = {r[0]: r[1] for r in catalog["t"].contains("fox").execute().scores().collect()}
    both = {r[0]: r[1] for r in catalog.execute("'fox' in t and v == 30").scores().collect()}
    assert both == pytest.approx({d: alone[d] + 1 for d in (2, 3)})
    either = {r[0]: r[1] for r in catalog.execute("'fox' in t or v >= 30").scores().collect()}
    assert either == pytest.approx({1: alone[1], 2: alone[2] + 1, 3: alone[3] + 1, 5: 1.0})


def test_sorting(catalog):
    r = catalog["v"].inrange(None, None).execute()
    assert list(r.sort(catalog["v"]).all(resolve=False)) == [1, 2, 3, 5]
    assert list(r.sort(catalog["v"], reverse=True, limit=3).all(resolve=False)) == [5, 3, 2]
    assert list(r.sort(catalog["v"], reverse=True, limit=3, sort_type="stable").all(resolve=False)) == [5, 2, 3]
    everything = catalog.execute("v == 30 or v != 30")
    with pytest.raises(Unsortable) as e:
        everything.sort(catalog["v"])
    assert e.value.docids == [4]
    assert list(everything.sort(catalog["v"], limit=2).all(resolve=False)) == [1, 2]
    assert len(everything.sort(catalog["v"], raise_unsortable=False)) == 4
    with pytest.raises(ValueError):
        r.sort(catalog["v"], limit=0)
    with pytest.raises(ValueError):
        r.sort(catalog["v"], sort_type="no")
    with pytest.raises(ValueError):
        r.sort(catalog["v"], reverse=True, sort_type=FWSCAN)
    with pytest.raises(TypeError):
        r.sort(catalog["k"])
    with pytest.raises(TypeError):
        r.sort(catalog["t"])
    t = catalog["t"].contains("fox").execute()
    assert list(t.sort(catalog["t"]).all(resolve=False)) == [3, 1, 2]
    assert list(t.sort(catalog["t"], reverse=True).all(resolve=False)) == [2, 1, 3]
    chained = t.sort(catalog["t"]).sort(catalog["v"], reverse=True)
    assert list(chained.all(resolve=False)) == [3, 2, 1]


def test_result_verbs(catalog):
    r = catalog["v"].eq(30).execute()
    assert r.first(resolve=False) == 2 and r.first()["v"] == 30 and len(r) == 2
    with pytest.raises(MultipleResults):
        r.one()
    with pytest.raises(NoResults):
        catalog["v"].eq(7).execute().one()
    assert catalog["v"].eq(7).execute().first() is None
    assert catalog["v"].eq(6).execute(resolver=lambda i: f"doc{i}").one() == "doc1"
    assert [d["docid"] for d in r] == [2, 3]
    kept = r.sort(catalog["v"], reverse=True).intersect(catalog["k"].eq("c").execute())
    assert list(kept.all(resolve=False)) == [2, 3]


def test_facet_counts(catalog):
    f = catalog["f"]
    assert {r[0]: r[1] for r in f.counts().collect()} == {"price": 3, "price:low": 2, "price:low:sale": 1, "price:high": 1, "color": 1, "color:red": 1}
    got = f.counts(f.eq("price:low").execute(), ["price:low"])
    assert {r[0]: r[1] for r in got.collect()} == {"price:low:sale": 1, "color": 1, "color:red": 1}


def test_statistics(catalog):
    v, k, t = catalog["v"], catalog["k"], catalog["t"]
    assert (v.docids_count(), v.indexed_count(), v.not_indexed_count(), v.word_count()) == (5, 4, 1, 3)
    assert (k.docids_count(), k.indexed_count(), k.not_indexed_count(), k.word_count()) == (4, 3, 1, 3)
    assert [r[0] for r in v.unique_values().collect()] == [6, 30, 94]
    assert t.document_repr(1) == "quick brown fox" and v.document_repr(2) == "30" and v.document_repr(4) is None
    assert {r["term"]: (r["df"], r["cf"]) for r in t.term_stats().collect()}["fox"] == (3, 3)


def test_legacy_search(catalog):
    assert ids(catalog.search(v=(6, 30))[1]) == [1, 2, 3]
    assert ids(catalog.search(v=[6, 94])[1]) == [1, 5]
    assert ids(catalog.search(v=None)[1]) == [1, 2, 3, 5]
    assert ids(catalog.search(v={"query": [RangeValue(6, 30), 30], "operator": "and"})[1]) == [2, 3]
    assert ids(catalog.search(k=["b", "c"])[1]) == [2]
    assert ids(catalog.search(k={"query": ["a", "c"], "operator": "or"}, t="fox")[1]) == [1, 2, 3]
    assert catalog.search() == (0, ())
    with pytest.raises(ValueError):
        catalog.search(none=1)
    with pytest.raises(TypeError):
        catalog.search(k={"query": ["a"], "operator": "xor"})


def test_maintenance(spark):
    c = Catalog(spark.createDataFrame([(1, "Zorro"), (2, "fox")], "docid long, t string"))
    c["t"] = TextIndex("t")
    c.index_doc(1, {"t": "a new fox"}).index_doc(3, {"t": "zorro fox"})
    assert ids(c["t"].contains("zorro").execute()) == [3] and ids(c["t"].contains("fox").execute()) == [1, 2, 3]
    c.unindex_doc(2).unindex_doc(99)
    assert ids(c["t"].contains("fox").execute()) == [1, 3]
    with pytest.raises(ValueError):
        c.index_doc("x", {"t": ""})
    c.reset()
    assert c["t"].docids_count() == 0 and ids(c["t"].contains("fox").execute()) == []
    with pytest.raises(ValueError):
        Catalog(spark.createDataFrame([("a",)], "docid string"))


def test_index_types(spark):
    c = Catalog(spark.createDataFrame([(1, {"a": 1}, "x", ["A", "a"])], "docid long, m map<string,int>, s string, k array<string>"))
    with pytest.raises(ValueError):
        FieldIndex(3)
    c["m"] = FieldIndex("m")
    with pytest.raises(ValueError):
        c.frame()
    c = Catalog(c.documents)
    c["s"] = KeywordIndex("s")
    with pytest.raises(TypeError):
        c.frame()
    from pyspark.sql import functions as F

    c = Catalog(c.documents)
    c["k"] = KeywordIndex("k", F.lower, str.lower)
    assert ids(c["k"].eq("A").execute()) == [1] and c["k"].word_count() == 1
    assert ids(c.execute("k == x", names={"x": "a"})) == [1] and Name("x") == Name("x")


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "docid long, v int, s string").write.parquet(f"{tmp_path}/d")
    c = Catalog(spark.read.parquet(f"{tmp_path}/d"))
    c["v"], c["s"] = FieldIndex("v"), FieldIndex("s")
    v, s = c["v"], c["s"]
    queries = [v.eq(5), v.noteq(5), v.gt(1), v.ge(1), v.lt(9), v.le(9), v.any([5, 6]), v.notany([6, None]), v.inrange(1, 9), v.inrange(1, 9, True, True), v.inrange(None, 9), v.inrange(1, None), v.notinrange(7, 9), v.eq(5) & s.eq("a"), v.eq(5) | s.noteq("b"), Not(v.gt(1) & s.eq("b"))]
    for q in queries:
        plan = q.execute().rows._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan, str(q)
    assert [ids(q.execute()) for q in queries] == [[1], [2], [1], [1], [1], [1], [1], [1, 2], [1], [1], [1], [1], [1, 2], [1], [1], [1]]


def test_a_batch_that_repeats_an_id(spark):
    c = Catalog(spark.createDataFrame([(1, "a", 0)], "docid long, t string, at int"))
    c["t"] = FieldIndex("t")
    c.index_docs(spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1), (2, "x", 1), (None, "y", 3)], "docid long, t string, at int"), order="at")
    assert sorted(map(tuple, c.documents.collect())) == [(1, "new", 2), (2, "x", 1)]


def test_unsortable_names_some_of_many(spark):
    c = Catalog(spark.range(0, 1500).selectExpr("id AS docid", "CAST(NULL AS INT) AS v"))
    c["v"] = FieldIndex("v")
    with pytest.raises(Unsortable) as e:
        c["v"].noteq(1).execute().sort(c["v"])
    assert e.value.n == 1500 and e.value.docids == list(range(Unsortable.SHOWN))


def test_kept_postings(spark, tmp_path):
    """Kept postings answer as derived words do, before and after changes, in a new catalog too."""
    rows = [(i, None if i == 3 else " ".join(f"w{(i * k) % 7}" for k in range(i)) + (" fox jumps" if i % 2 else " jumps fox"), i % 3) for i in range(12)]
    docs = spark.createDataFrame(rows, "docid long, t string, v int")

    def catalog(kept):
        c = Catalog(docs)
        c["t"], c["cos"], c["v"] = TextIndex("t"), TextIndex("t", ranker=Cosine()), FieldIndex("v")
        if kept:
            c["t"].store(f"file://{tmp_path}/t")
            c["cos"].store(f"file://{tmp_path}/cos")
        return c

    queries = ["w1 w2", "none", "fox and not w1", '"jumps fox" or w5', "fo* or w3"]

    def same(a, b):
        for q in queries:
            for index in ("t", "cos")[: 2 if q == queries[0] else 1]:
                for more in ("", " and v == 1", " or v == 1")[: 3 if q == queries[-1] and len(queries) > 1 else 1]:
                    x, y = (c.execute(f"{q!r} in {index}{more}").scores().collect() for c in (a, b))
                    assert sorted((r[0], round(r[1], 9)) for r in x) == sorted((r[0], round(r[1], 9)) for r in y), (index, q, more)
        assert ids(a["t"].notcontains("fox").execute()) == ids(b["t"].notcontains("fox").execute())

    plain, kept = catalog(False), catalog(True)
    same(plain, kept)
    queries = ['w1 or "fox jumps"']
    change = spark.createDataFrame([(1, "w1 w1 new", 1), (2, None, 0), (40, "fox w1", 1)], "docid long, t string, v int")
    for c in (plain, kept):
        c.index_docs(change).unindex_doc(5).index_doc(6, {"t": "fox jumps", "v": 1})
    same(plain, kept)
    assert len(kept["t"].kept.state["segments"]) == 4
    kept["t"].optimize()
    kept["t"].kept.cache()
    same(plain, kept)
    assert len(kept["t"].kept.state["segments"]) == 1
    again = Catalog(plain.documents)
    again["t"], again["cos"], again["v"] = TextIndex("t"), TextIndex("t", ranker=Cosine()), FieldIndex("v")
    again["t"].open(f"file://{tmp_path}/t")
    same(plain, again)
    kept.reset()
    assert ids(kept["t"].contains("fox").execute()) == []


def test_lexicon_and_result_factory(spark):
    class Counted(ResultSet):
        pass

    c = Catalog(spark.createDataFrame([(1, "quick fox fox"), (2, None)], "docid long, t string"), results=Counted)
    c["t"] = TextIndex("t")
    t = c["t"]
    assert {r["word"] for r in t.lexicon().collect()} == {"quick", "fox"}
    assert t.get_word(t.get_wid("fox")) == "fox" and t.get_wid("none") == 0 and t.get_word(5) is None
    assert t.get_words(1) == ["quick", "fox", "fox"] and t.get_words(2) == [] and t.has_doc(1) and not t.has_doc(2)
    found = t.contains("fox").execute()
    assert type(found) is Counted and type(found.sort(t)) is Counted


def analyses(df):
    """How often a plan splits texts into words."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_phrases_analyse_a_text_once(spark):
    """A filter that is pushed to the scan must not analyse the text again for each of its words."""
    c = Catalog(spark.createDataFrame([(1, "a1 b1 b1 c1"), (2, "b1 a1"), (3, "b1"), (4, None), (5, ""), (6, "a1 b1 c1 a1")], "docid long, t string"))
    c["t"] = TextIndex("t")
    found = c["t"].contains('"a1 b1"').execute()
    assert ids(found) == [1, 6] and analyses(found.rows) == 1
    assert ids(c["t"].contains('"b1 b1"').execute()) == [1]
    assert ids(c["t"].contains('"a1 b1 c1"').execute()) == [6]
    assert ids(c["t"].contains('"a1 b1" or "b1 a1"').execute()) == [1, 2, 6]
    assert ids(c["t"].notcontains('"a1 b1"').execute()) == [2, 3, 4, 5]


def test_norms_without_a_shuffle(spark):
    c = Catalog(spark.createDataFrame([(1, "a1 b1 b1 c1 b1"), (2, "b1 a1"), (3, "c1"), (4, None), (5, "")], "docid long, t string"))
    c["t"] = TextIndex("t", ranker=Cosine())
    found = c["t"].contains("a1 or b1").execute()
    assert "Join" not in found.rows._jdf.queryExecution().optimizedPlan().toString() and analyses(found.rows) == 1
    weight = {"a1": math.log(1 + 4 / 2), "b1": math.log(1 + 4 / 2)}
    query, three = math.hypot(*weight.values()), 1 + math.log(3)
    want = {1: (weight["a1"] + three * weight["b1"]) / math.sqrt(2 + three**2) / query, 2: sum(weight.values()) / math.sqrt(2) / query}
    assert {r[0]: r[1] for r in found.scores().collect()} == pytest.approx(want)


def test_statistics_analyse_a_text_once(spark, monkeypatch):
    from docgrove.plans.compiler import Compiler

    c = Catalog(spark.createDataFrame([(1, "a1 b1 b1"), (2, "b1"), (3, "c1"), (4, None), (5, "")], "docid long, t string"))
    c["t"] = TextIndex("t")
    plans, first = [], type(c.documents).first
    monkeypatch.setattr(type(c.documents), "first", lambda df: plans.append(df) or first(df))
    assert Compiler(c).statistics(c["t"], ["a1", "b1", "d1"]) == (4, 5, {"a1": 1, "b1": 2, "d1": 0})
    assert [analyses(p) for p in plans] == [1]


def test_kept_words_are_counted_without_a_shuffle(spark, tmp_path):
    """Forward rows come from a document's own words, in order, with nulls among them or none at all."""
    from docgrove.sources.postings import PostingStore

    kept = PostingStore(spark, f"file://{tmp_path}/t", "docid")
    rows = spark.createDataFrame([(1, ["b1", "a1", "b1", None, "c1"]), (2, []), (3, None), (4, [None]), (-5, ["ä1"])], "docid long, terms array<string>").coalesce(1)
    forward = kept._forward(rows)
    assert "Exchange" not in forward._jdf.queryExecution().executedPlan().toString()
    got = {r["docid"]: (r["length"], {w["term"]: (w["tf"], w["places"]) for w in r["words"]}, r["norm"]) for r in forward.collect()}
    want = {1: (4, {"a1": (1, [1]), "b1": (2, [0, 2]), "c1": (1, [4])}, math.sqrt(2 + (1 + math.log(2)) ** 2)), 2: (0, {}, 0.0), 4: (0, {}, 0.0), -5: (1, {"ä1": (1, [0])}, 1.0)}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][2] == pytest.approx(v[2]) for k, v in want.items())


@pytest.mark.parametrize("part", [1 << 30, 2000, 20])
def test_kept_postings_in_parts(spark, tmp_path, monkeypatch, part):
    """One part, some for the buckets, slices of each bucket: the same postings, a bucket of a word holds them all."""
    from docgrove.sources import blocks, postings

    monkeypatch.setattr(postings, "PART", part)
    docs = spark.range(300).selectExpr("id AS docid", "concat_ws(' ', 'all1', 'w' || id % 50, 'w' || id % 7, 'x' || id) AS t").repartition(3)
    c = Catalog(docs, "docid")
    c["t"] = TextIndex("t")
    c["t"].store(f"file://{tmp_path}/t")
    kept = c["t"].kept
    want = {}
    for d in range(300):
        for place, w in enumerate(["all1", f"w{d % 50}", f"w{d % 7}", f"x{d}"]):
            want.setdefault((w, d), []).append(place)
    got = kept._read(kept.state["segments"][0]["name"], "postings").collect()
    assert {(r["term"], r["docid"]): r["places"] for r in got} == want and len(got) == len(want)
    assert all(r["tf"] == len(r["places"]) and r["length"] == 4 and r["bucket"] == blocks.bucket_of(r["term"].encode()) for r in got)
    assert kept.postings(["all1"]).count() == 300 and ids(c["t"].contains('"w3 w3" or x299').execute()) == [*[d for d in range(300) if d % 50 == d % 7 == 3], 299]
    terms = {r["term"]: (r["df"], r["cf"]) for r in kept._read(kept.state["segments"][0]["name"], "terms").collect()}
    assert terms["all1"] == (300, 300) and terms["x7"] == (1, 1) and len(terms) == 351


def test_kept_postings_of_repeated_ids_and_earlier_versions(spark, tmp_path):
    from pyspark.sql import functions as F

    from docgrove.sources.postings import PostingStore

    rows = spark.createDataFrame([(1, ["a1", "b1"]), (1, ["c1", "a1"]), (2, ["a1"]), (3, None)], "docid long, terms array<string>")
    kept = PostingStore(spark, f"file://{tmp_path}/t", "docid").write(rows)
    got = {(r["term"], r["docid"]): r["places"] for r in kept.postings(["a1", "b1", "c1"]).collect()}
    assert got == {("a1", 1): [0, 4], ("b1", 1): [1], ("c1", 1): [3], ("a1", 2): [0]}  # a gap between the rows
    assert kept.statistics(["a1"]) == (2, 5, {"a1": 2})
    # a segment without the name of its hash has buckets by xxhash64, as earlier versions wrote them
    (segment,) = kept.state["segments"]
    at = f"{kept.folder.path}/{segment['name']}/postings"
    spark.read.parquet(at).withColumn("bucket", kept._bucket(F.col("term"))).write.partitionBy("bucket").parquet(f"{at}-old")
    old = PostingStore(spark, f"file://{tmp_path}/t", "docid")
    old.state["segments"] = [{"name": segment["name"], "gone": False}]
    old._schema["postings"], read = kept._schema["postings"], old._read
    old._read = lambda s, table: spark.read.schema(old._schema[table]).parquet(f"{at}-old") if table == "postings" else read(s, table)
    assert old.postings(["a1"]).count() == 2 and old.postings(["a1", "c1"]).count() == 3


def test_replaced_documents_are_not_shuffled_by_their_words(spark, tmp_path, monkeypatch):
    """Replaced ids are sent to the words of documents, though they are more than are looked up by value, and are written once."""
    from docgrove.sources import postings

    monkeypatch.setattr(postings, "FEW", 3)
    c = Catalog(spark.range(40).selectExpr("id AS docid", "'fox a' || id % 4 AS t"), "docid")
    c["t"] = TextIndex("t")
    c["t"].store(f"file://{tmp_path}/t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c.index_docs(c.documents.where("docid % 4 = 1").selectExpr("docid", "'b1 fox' AS t")).unindex_docs(c.documents.where("docid % 4 = 2"))
        kept = c["t"].kept
        assert kept.statistics(["fox", "a1", "a2", "b1"]) == (30, 60, {"fox": 30, "a1": 0, "a2": 0, "b1": 10})
        assert ids(c["t"].contains("fox").execute()) == [i for i in range(40) if i % 4 != 2] and ids(c["t"].contains("b1").execute()) == list(range(1, 40, 4))
        assert [s.get("ids", 0) for s in kept.state["segments"]] == [0, 10, 10]
        assert "SortMergeJoin" not in kept._live("forward")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
