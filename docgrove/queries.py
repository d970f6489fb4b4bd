"""One query for each operator of the catalog, over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import Catalog, Cosine, FacetIndex, FieldIndex, HTML, KeywordIndex, Name, Not, Or, TextIndex
from .catalog import RangeValue
from .functions.analysis import STOP_WORDS, Analyzer, DropWords, Lower, Split
from .results import ResultSet
from .sources.folders import scratch
from .sources.tables import merge_parts, read
from .streaming.upserts import DocumentTable

Maker = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Maker] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Maker], Maker]:
    def register(fn: Maker) -> Maker:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


# catalogs


def orders(spark: SparkSession, sf_dir: str) -> Catalog:
    c = Catalog(_table(spark, sf_dir, "orders"), "o_orderkey")
    c["status"], c["price"], c["priority"], c["date"], c["cust.key"] = FieldIndex("o_orderstatus"), FieldIndex("o_totalprice"), FieldIndex("o_orderpriority"), FieldIndex("o_orderdate"), FieldIndex("o_custkey")
    return c


def labelled(spark: SparkSession, sf_dir: str) -> Catalog:
    """Documents with their labels; most have none."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    c = Catalog(docs, "doc_id")
    c["quality"], c["toxic"], c["lang"], c["n_chars"], c["text"] = FieldIndex("quality"), FieldIndex("toxic"), FieldIndex("lang"), FieldIndex("n_chars"), TextIndex("text")
    c["origin"] = KeywordIndex(F.array("lang", "source"))
    return c


def keyworded(spark: SparkSession, sf_dir: str) -> Catalog:
    """Orders with the flags, statuses and line numbers of their lines; some have none."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"), F.collect_set(F.col("l_linenumber").cast("string")).alias("c"))
    lines = lines.select("l_orderkey", F.concat("a", "b", "c").alias("words"))
    docs = _table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "words")
    c = Catalog(docs, "o_orderkey")
    c["words"] = KeywordIndex("words")
    return c


_TYPES = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")


def parts(spark: SparkSession, sf_dir: str) -> Catalog:
    """Parts under facets type:<p_type>:<p_brand> and size:<band>."""
    docs = _table(spark, sf_dir, "part")
    kinds = [r[0] for r in docs.select("p_type").distinct().collect()]
    brands = [r[0] for r in docs.select("p_brand").distinct().collect()]
    facets = ["type", "size", "size:small", *[f"type:{t}" for t in kinds], *[f"type:{t}:{b}" for t in kinds for b in brands]]
    paths = F.array(F.concat_ws(":", F.lit("type"), "p_type", "p_brand"), F.concat(F.lit("size:"), F.when(F.col("p_size") <= 25, "small").otherwise("large")))
    c = Catalog(docs, "p_partkey")
    c["facets"] = FacetIndex(paths, facets)
    return c


def days(spark: SparkSession, sf_dir: str) -> Catalog:
    """Events under facets year:month:day of their dates, all declared."""
    docs = _table(spark, sf_dir, "events")
    path = F.date_format("ts", "yyyy:MM:dd")
    known = [r[0] for r in docs.select(path.alias("p")).distinct().collect()]
    c = Catalog(docs, "event_id")
    c["day"] = FacetIndex(F.array(path), {":".join(p.split(":")[:i]) for p in known for i in (1, 2, 3)})
    return c


def texts(spark: SparkSession, sf_dir: str) -> Catalog:
    c = Catalog(_table(spark, sf_dir, "documents"), "doc_id")
    c["text"], c["cosine"], c["lang"] = TextIndex("text"), TextIndex("text", ranker=Cosine()), FieldIndex("lang")
    return c


def ranked(result: ResultSet, more: list[str] | None = None) -> DataFrame:
    """The ids of a limited result with their rank from 1."""
    id_col = result.catalog.id
    rows = result.rows.withColumn("rank", F.row_number().over(Window.orderBy(*result.order)).cast("long"))
    if result.scored:
        rows = rows.withColumn("score", F.round("score", 6))
    return rows.select(id_col, "rank", *(["score"] if result.scored else []))


# fields

_FIELD = {
    "field_eq": (lambda c: c["status"].eq("F"), "o_orderstatus = 'F'"),
    "field_noteq": (lambda c: c["status"].noteq("F"), "o_orderstatus IS DISTINCT FROM 'F'"),
    "field_gt": (lambda c: c["price"].gt(150000.0), "o_totalprice > 150000"),
    "field_ge": (lambda c: c["cust.key"].ge(700), "o_custkey >= 700"),
    "field_lt": (lambda c: c["price"].lt(20000.0), "o_totalprice < 20000"),
    "field_le": (lambda c: c["cust.key"].le(70), "o_custkey <= 70"),
    "field_any": (lambda c: c["priority"].any(["1-URGENT", "5-LOW"]), "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "field_notany": (lambda c: c["priority"].notany(["1-URGENT", "5-LOW"]), "NOT coalesce(o_orderpriority IN ('1-URGENT', '5-LOW'), false)"),
    "field_inrange": (lambda c: c["price"].inrange(1000.0, 50000.0), "o_totalprice BETWEEN 1000 AND 50000"),
    "field_inrange_exclusive": (lambda c: c["cust.key"].inrange(10, 20, True, True), "o_custkey > 10 AND o_custkey < 20"),
    "field_inrange_open_low": (lambda c: c["cust.key"].inrange(None, 20, False, True), "o_custkey < 20"),
    "field_inrange_open_high": (lambda c: c["cust.key"].inrange(100, None, True, False), "o_custkey > 100"),
    "field_notinrange": (lambda c: c["price"].notinrange(1000.0, 50000.0), "NOT coalesce(o_totalprice BETWEEN 1000 AND 50000, false)"),
    "and_tree": (lambda c: c["status"].eq("F") & c["price"].gt(100000.0) & c["priority"].noteq("5-LOW"), "o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'"),
    "or_tree": (lambda c: c["status"].eq("P") | c["price"].gt(300000.0), "o_orderstatus = 'P' OR o_totalprice > 300000"),
    "not_demorgan": (lambda c: Not(c["status"].eq("F") & (c["price"].gt(100000.0) | c["priority"].eq("5-LOW"))), "o_orderstatus <> 'F' OR (o_totalprice <= 100000 AND o_orderpriority <> '5-LOW')"),
    "cqe_range": ("status == 'F' and 1000 < price <= 50000 and not (priority == '1-URGENT')", "o_orderstatus = 'F' AND o_totalprice > 1000 AND o_totalprice <= 50000 AND o_orderpriority <> '1-URGENT'"),
    "cqe_any": ("status in any(['F', 'P']) or priority not in any(['1-URGENT', '2-HIGH', '5-LOW'])", "o_orderstatus IN ('F', 'P') OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')"),
    "cqe_dotted": ("cust.key > 100 and cust.key <= 200", "o_custkey > 100 AND o_custkey <= 200"),
}


def _field_query(query: object) -> Maker:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = orders(spark, sf_dir)
        return c.execute(query if isinstance(query, str) else query(c)).ids()

    return run


for _name, (_query, _where) in _FIELD.items():
    QUERIES[_name] = _field_query(_query)
    ORACLES[_name] = f"SELECT o_orderkey FROM orders WHERE {_where}"

_LABELS = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@_add("field_noteq_missing", f"SELECT d.doc_id FROM {_LABELS} WHERE quality IS DISTINCT FROM 1")
def _(spark, sf_dir):
    return labelled(spark, sf_dir)["quality"].noteq(1).execute().ids()


@_add("not_gt_vs_le", f"SELECT d.doc_id FROM {_LABELS} WHERE quality <= 0")
def _(spark, sf_dir):
    c = labelled(spark, sf_dir)
    return Not(c["quality"].gt(0)).execute().ids()


@_add("field_notinrange_missing", f"SELECT d.doc_id FROM {_LABELS} WHERE NOT coalesce(quality BETWEEN 1 AND 2, false)")
def _(spark, sf_dir):
    return labelled(spark, sf_dir)["quality"].notinrange(1, 2).execute().ids()


@_add("names_bound", f"SELECT d.doc_id FROM {_LABELS} WHERE lang IN ('en', 'fr') AND n_chars >= 500 AND n_chars < 5000")
def _(spark, sf_dir):
    return labelled(spark, sf_dir).execute("lang in any([one, other]) and low <= n_chars < high", names={"one": "en", "other": "fr", "low": 500, "high": 5000}).ids()


# keywords

_WORDS = """WITH k AS (SELECT o_orderkey, l_orderkey IS NULL AS missing,
 list_distinct(list_concat(list_concat(list(DISTINCT l_returnflag), list(DISTINCT l_linestatus)), list(DISTINCT CAST(l_linenumber AS VARCHAR)))) AS words
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, l_orderkey) SELECT o_orderkey FROM k WHERE """
_KEYWORD = {
    "kw_eq": (lambda i: i.eq("R"), "list_contains(words, 'R')"),
    "kw_noteq": (lambda i: i.noteq("R"), "missing OR NOT list_contains(words, 'R')"),
    "kw_any": (lambda i: i.any(["R", "7"]), "list_contains(words, 'R') OR list_contains(words, '7')"),
    "kw_notany": (lambda i: i.notany(["R", "7"]), "missing OR NOT (list_contains(words, 'R') OR list_contains(words, '7'))"),
    "kw_all": (lambda i: i.all(["A", "R", "3"]), "list_contains(words, 'A') AND list_contains(words, 'R') AND list_contains(words, '3')"),
    "kw_notall": (lambda i: i.notall(["A", "R", "3"]), "missing OR NOT (list_contains(words, 'A') AND list_contains(words, 'R') AND list_contains(words, '3'))"),
}


def _keyword_query(make: Callable) -> Maker:
    return lambda spark, sf_dir: make(keyworded(spark, sf_dir)["words"]).execute().ids()


for _name, (_make, _where) in _KEYWORD.items():
    QUERIES[_name] = _keyword_query(_make)
    ORACLES[_name] = _WORDS + f"({_where})"

_FACETS = """WITH f AS (SELECT p_partkey, unnest(list_concat(['type', 'type:' || p_type, 'type:' || p_type || ':' || p_brand, 'size'], CASE WHEN p_size <= 25 THEN ['size:small'] ELSE [] END)) AS facet FROM part) """


@_add("facet_eq", _FACETS + "SELECT p_partkey FROM f WHERE facet = 'size:small'")
def _(spark, sf_dir):
    return parts(spark, sf_dir)["facets"].eq("size:small").execute().ids()


@_add("facet_any", _FACETS + "SELECT DISTINCT p_partkey FROM f WHERE facet IN ((SELECT 'type:' || min(p_type) FROM part), (SELECT 'type:' || max(p_type) FROM part))")
def _(spark, sf_dir):
    c = parts(spark, sf_dir)
    low, high = c.documents.agg(F.min("p_type"), F.max("p_type")).first()
    return c["facets"].any([f"type:{low}", f"type:{high}"]).execute().ids()


@_add("facet_all", _FACETS + "SELECT p_partkey FROM f WHERE facet IN ('size:small', (SELECT 'type:' || min(p_type) FROM part)) GROUP BY p_partkey HAVING count(DISTINCT facet) = 2")
def _(spark, sf_dir):
    c = parts(spark, sf_dir)
    low = c.documents.agg(F.min("p_type")).first()[0]
    return c["facets"].all([f"type:{low}", "size:small"]).execute().ids()


@_add("facet_counts", _FACETS + "SELECT facet, count(*) AS n FROM f GROUP BY facet")
def _(spark, sf_dir):
    return parts(spark, sf_dir)["facets"].counts()


@_add("facet_counts_omit", _FACETS + "SELECT facet, count(*) AS n FROM f WHERE p_partkey IN (SELECT p_partkey FROM f WHERE facet = 'size:small') AND facet NOT IN ('size', 'size:small') GROUP BY facet")
def _(spark, sf_dir):
    i = parts(spark, sf_dir)["facets"]
    return i.counts(i.eq("size:small").execute(), ["size:small"])


@_add("facet_days", "WITH e AS (SELECT strftime(ts, '%Y:%m:%d') AS p FROM events) SELECT facet, count(*) AS n FROM (SELECT unnest([split_part(p, ':', 1), split_part(p, ':', 1) || ':' || split_part(p, ':', 2), p]) AS facet FROM e) GROUP BY facet")
def _(spark, sf_dir):
    return days(spark, sf_dir)["day"].counts()


# text

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PLACES = rf"""WITH w AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP}))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN tf ON d.doc_id = tf.doc_id GROUP BY d.doc_id),
c AS (SELECT count(*) AS n, sum(len) / count(*) AS mean FROM len),
s AS (SELECT tf.doc_id, tf.term, ln(1e0 + n / df) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean)) AS s, ln(1e0 + n / df) * 2.2e0 AS qw
 FROM tf JOIN df ON tf.term = df.term JOIN len ON tf.doc_id = len.doc_id CROSS JOIN c) """


def _weight(*terms: str) -> str:
    """The query weight of words, repeats counted."""
    return "(" + " + ".join(f"coalesce((SELECT max(qw) FROM s WHERE term = '{t}'), 0)" for t in terms) + ")"


def _text_query(query: str, index: str = "text") -> Maker:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir)[index].contains(query).execute().scores().select("doc_id", F.round("score", 6).alias("score"))

    return run


_TEXT = {
    "text_term": ("th", f"SELECT doc_id, round(s / {_weight('th')}, 6) AS score FROM s WHERE term = 'th'"),
    "text_and": ("th er", f"SELECT doc_id, round(sum(s) / {_weight('th', 'er')}, 6) AS score FROM s WHERE term IN ('th', 'er') GROUP BY doc_id HAVING count(*) = 2"),
    "text_or": ("th or er", f"SELECT doc_id, round(sum(s) / {_weight('th', 'er')}, 6) AS score FROM s WHERE term IN ('th', 'er') GROUP BY doc_id"),
    "text_and_not": ("th and not er", f"SELECT doc_id, round(s / {_weight('th')}, 6) AS score FROM s WHERE term = 'th' AND doc_id NOT IN (SELECT doc_id FROM s WHERE term = 'er')"),
    "text_glob": ("tha*", "SELECT doc_id, round(sum(s), 6) AS score FROM s WHERE term LIKE 'tha%' GROUP BY doc_id"),
}
for _name, (_query, _sql) in _TEXT.items():
    QUERIES[_name] = _text_query(_query)
    ORACLES[_name] = _PLACES + _sql
ORACLES["text_glob"] = _PLACES + f"SELECT doc_id, round(sum(s) / CASE WHEN {_weight('tha')} = 0 THEN 1e0 ELSE {_weight('tha')} END, 6) AS score FROM s WHERE term LIKE 'tha%' GROUP BY doc_id"

_ROW = rf"list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP}))"
QUERIES["text_phrase"] = _text_query('"th er"')
ORACLES["text_phrase"] = _PLACES + f"""SELECT doc_id, round(sum(s) / {_weight('th', 'er')}, 6) AS score FROM s WHERE term IN ('th', 'er') AND doc_id IN
 (SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_ROW}, ' ') || ' ', ' th er ')) GROUP BY doc_id"""
QUERIES["text_cosine"] = _text_query("th er", "cosine")
ORACLES["text_cosine"] = _PLACES + """, nrm AS (SELECT doc_id, sqrt(sum((1e0 + ln(tf)) * (1e0 + ln(tf)))) AS nrm FROM tf GROUP BY doc_id),
 q AS (SELECT term, ln(1e0 + n / df) AS idf FROM df CROSS JOIN c WHERE term IN ('th', 'er'))
 SELECT tf.doc_id, round(sum((1e0 + ln(tf)) / nrm * idf) / (SELECT sqrt(sum(idf * idf)) FROM q), 6) AS score
 FROM tf JOIN q ON tf.term = q.term JOIN nrm ON tf.doc_id = nrm.doc_id GROUP BY tf.doc_id HAVING count(*) = 2"""


@_add("text_notcontains", _PLACES + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE term = 'th')")
def _(spark, sf_dir):
    return texts(spark, sf_dir)["text"].notcontains("th").execute().ids()


@_add("text_html", r"""WITH h AS (SELECT page_id, regexp_extract_all(regexp_replace(lower(html), '(<[^<>]*>|&[A-Za-z]+;)', ' ', 'g'), '[\p{L}\p{N}_]+') AS t FROM pages)
 SELECT page_id FROM h WHERE list_contains(t, 'track') OR list_contains(t, 'und')""")
def _(spark, sf_dir):
    c = Catalog(_table(spark, sf_dir, "pages"), "page_id")
    c["html"] = TextIndex("html", HTML)
    return c.execute("'track or und' in html").ids()


@_add("text_parts", r"""SELECT DISTINCT conv_id FROM conversations WHERE list_contains(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)), 'th')""")
def _(spark, sf_dir):
    c = Catalog(merge_parts(_table(spark, sf_dir, "conversations"), "conv_id", "text", "turn"), "conv_id")
    c["text"] = TextIndex("text")
    return c["text"].contains("th").execute().ids()


@_add("text_and_field", _PLACES + f"SELECT s.doc_id, round(s / {_weight('th')} + 1, 6) AS score FROM s JOIN documents d ON s.doc_id = d.doc_id WHERE term = 'th' AND lang = 'en'")
def _(spark, sf_dir):
    return texts(spark, sf_dir).execute("'th' in text and lang == 'en'").scores().select("doc_id", F.round("score", 6).alias("score"))


@_add(
    "text_or_field",
    _PLACES
    + f"""SELECT d.doc_id, round(coalesce(s / {_weight('th')}, 0) + CASE WHEN lang = 'en' THEN 1 ELSE 0 END, 6) AS score
 FROM documents d LEFT JOIN (SELECT * FROM s WHERE term = 'th') x ON d.doc_id = x.doc_id WHERE lang = 'en' OR s IS NOT NULL""",
)
def _(spark, sf_dir):
    c = texts(spark, sf_dir)
    return Or(c["text"].contains("th"), c["lang"].eq("en")).execute().scores().select("doc_id", F.round("score", 6).alias("score"))


# the same answers from kept postings


def stored_texts(spark: SparkSession, sf_dir: str) -> Catalog:
    c = texts(spark, sf_dir)
    c["text"].store(f"{scratch(spark)}/text")
    c["cosine"].kept = c["text"].kept
    return c


def _stored_query(query: str, index: str = "text") -> Maker:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored_texts(spark, sf_dir)[index].contains(query).execute().scores().select("doc_id", F.round("score", 6).alias("score"))

    return run


for _name, _query in {**{k: q for k, (q, _) in _TEXT.items()}, "text_phrase": '"th er"'}.items():
    QUERIES[f"stored_{_name}"] = _stored_query(_query)
    ORACLES[f"stored_{_name}"] = ORACLES[_name]
QUERIES["stored_text_cosine"], ORACLES["stored_text_cosine"] = _stored_query("th er", "cosine"), ORACLES["text_cosine"]


@_add("stored_text_and_field", ORACLES["text_and_field"])
def _(spark, sf_dir):
    return stored_texts(spark, sf_dir).execute("'th' in text and lang == 'en'").scores().select("doc_id", F.round("score", 6).alias("score"))


_CHANGED = _PLACES.replace("FROM documents)", "FROM now)").replace("FROM documents d", "FROM now d").replace(
    "WITH w AS", "WITH now AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' th th er' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7), w AS", 1
)


@_add("stored_text_updated", _CHANGED + f"SELECT doc_id, round(sum(s) / {_weight('th', 'er')}, 6) AS score FROM s WHERE term IN ('th', 'er') GROUP BY doc_id HAVING count(*) = 2")
def _(spark, sf_dir):
    c = Catalog(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    c["text"] = TextIndex("text")
    c["text"].store(f"{scratch(spark)}/text")
    docs = c.documents
    c.index_docs(docs.where("doc_id % 10 = 3").withColumn("text", F.concat("text", F.lit(" th th er"))))
    c.unindex_docs(docs.where("doc_id % 10 = 7"))
    return c["text"].contains("th er").execute().scores().select("doc_id", F.round("score", 6).alias("score"))


@_add("text_parentheses", _PLACES + f"SELECT doc_id, round(sum(s) / {_weight('th', 'er', 'und')}, 6) AS score FROM s WHERE term IN ('th', 'er', 'und') GROUP BY doc_id HAVING count_if(term = 'th') = 1 AND count(*) > 1")
def _(spark, sf_dir):
    return texts(spark, sf_dir)["text"].contains("th and (er or und)").execute().scores().select("doc_id", F.round("score", 6).alias("score"))


@_add("text_single_chars", rf"""SELECT doc_id, array_to_string(list_filter({_ROW}, lambda x: length(x) > 1), ' ') AS words FROM documents""")
def _(spark, sf_dir):
    c = Catalog(_table(spark, sf_dir, "documents"), "doc_id")
    c["text"] = TextIndex("text", Analyzer(Split(), Lower(), DropWords(single=True)))
    return c.frame().select("doc_id", F.array_join(c["text"].column, " ").alias("words"))


@_add("term_frequencies", _PLACES + "SELECT doc_id, term, tf FROM tf")
def _(spark, sf_dir):
    return texts(spark, sf_dir)["text"].postings()


@_add("vocabulary", _PLACES + "SELECT tf.term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY tf.term")
def _(spark, sf_dir):
    return texts(spark, sf_dir)["text"].term_stats()


@_add("doc_weights", _PLACES + "SELECT doc_id, round(sqrt(sum((1e0 + ln(tf)) * (1e0 + ln(tf)))), 6) AS norm FROM tf GROUP BY doc_id")
def _(spark, sf_dir):
    return texts(spark, sf_dir)["text"].norms().select("doc_id", F.round("norm", 6).alias("norm"))


@_add("doc_repr", rf"SELECT doc_id, array_to_string({_ROW}, ' ') AS words FROM documents")
def _(spark, sf_dir):
    c = texts(spark, sf_dir)
    return c.frame().select("doc_id", F.array_join(c["text"].column, " ").alias("words"))


# sorting and results; limits here are the feature


def _top(order: str, limit: int, where: str = "true", table: str = "orders", key: str = "o_orderkey") -> str:
    return f"SELECT {key}, row_number() OVER (ORDER BY {order}) AS rank FROM {table} WHERE {where} QUALIFY row_number() OVER (ORDER BY {order}) <= {limit}"


@_add("sort_asc", _top("o_totalprice, o_orderkey", 1000, "o_orderstatus = 'F'"))
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return ranked(c["status"].eq("F").execute().sort(c["price"], limit=1000))


@_add("sort_desc", _top("o_custkey DESC, o_orderkey DESC", 250, "o_orderstatus = 'F'"))
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return ranked(c["status"].eq("F").execute().sort(c["cust.key"], reverse=True, limit=250))


@_add("sort_desc_stable", _top("o_custkey DESC, o_orderkey", 250, "o_orderstatus = 'F'"))
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return ranked(c["status"].eq("F").execute().sort(c["cust.key"], reverse=True, limit=250, sort_type="stable"))


@_add("sort_stable_chain", _top("o_orderpriority, o_totalprice DESC, o_orderkey", 300, "o_orderstatus = 'P'"))
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return ranked(c["status"].eq("P").execute().sort(c["price"], reverse=True).sort(c["priority"], limit=300))


@_add("sort_skip_missing", _top("quality, d.doc_id", 200, "quality IS NOT NULL AND lang = 'en'", _LABELS, "d.doc_id"))
def _(spark, sf_dir):
    c = labelled(spark, sf_dir)
    return ranked(c["lang"].eq("en").execute().sort(c["quality"], limit=200, raise_unsortable=False))


def _relevance(order: str) -> str:
    return _PLACES + f"SELECT doc_id, rank, score FROM (SELECT doc_id, round(s / {_weight('th')}, 6) AS score, row_number() OVER (ORDER BY s {order}, doc_id {order}) AS rank FROM s WHERE term = 'th') WHERE rank <= 20"


@_add("sort_relevance", _relevance("DESC"))
def _(spark, sf_dir):
    c = texts(spark, sf_dir)
    return ranked(c["text"].contains("th").execute().sort(c["text"], limit=20))


@_add("sort_relevance_reverse", _relevance("ASC"))
def _(spark, sf_dir):
    c = texts(spark, sf_dir)
    return ranked(c["text"].contains("th").execute().sort(c["text"], reverse=True, limit=20))


@_add("rs_first", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 1")
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return spark.createDataFrame([(c["status"].eq("P").execute().sort(c["price"]).first(resolve=False),)], "o_orderkey long")


@_add("rs_intersect", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return c["status"].eq("F").execute().intersect(c["price"].gt(200000.0).execute()).ids()


@_add("rs_resolve", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000")
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return (c["status"].eq("P") & c["price"].gt(100000.0)).execute().documents().select("o_orderkey", "o_custkey", "o_totalprice")


@_add("search_legacy", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('F', 'P')")
def _(spark, sf_dir):
    return orders(spark, sf_dir).search(price=(1000.0, 90000.0), status=["F", "P"])[1].ids()


@_add("search_ordered", _top("o_totalprice, o_orderkey", 50, "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"))
def _(spark, sf_dir):
    return ranked(orders(spark, sf_dir).search(sort_index="price", limit=50, index_query_order=["priority", "status"], status="F", priority={"query": ["1-URGENT"], "operator": "and"})[1])


_SEARCHES = {
    "search_scalar": ({"status": "F"}, "o_orderstatus = 'F'"),
    "search_none": ({"price": None}, "o_totalprice IS NOT NULL"),
    "search_range_value": ({"cust.key": [RangeValue(10, 30), 70]}, "o_custkey BETWEEN 10 AND 30 OR o_custkey = 70"),
    "search_operator": ({"cust.key": {"query": [RangeValue(10, 30), RangeValue(20, 40)], "operator": "and"}}, "o_custkey BETWEEN 20 AND 30"),
}


def _search_query(terms: dict) -> Maker:
    return lambda spark, sf_dir: orders(spark, sf_dir).search(**terms)[1].ids()


for _name, (_terms, _where) in _SEARCHES.items():
    QUERIES[_name], ORACLES[_name] = _search_query(_terms), f"SELECT o_orderkey FROM orders WHERE {_where}"

_WORDS = "(SELECT l_orderkey, list_distinct(list_concat(list(l_returnflag), list(l_linestatus), list(CAST(l_linenumber AS VARCHAR)))) AS words FROM lineitem GROUP BY l_orderkey)"


@_add("search_keywords", f"SELECT o_orderkey FROM orders JOIN {_WORDS} ON o_orderkey = l_orderkey WHERE list_contains(words, 'R') AND list_contains(words, '5')")
def _(spark, sf_dir):
    return keyworded(spark, sf_dir).search(words=["R", "5"])[1].ids()


@_add("search_keywords_or", f"SELECT o_orderkey FROM orders JOIN {_WORDS} ON o_orderkey = l_orderkey WHERE list_contains(words, 'R') OR list_contains(words, '5')")
def _(spark, sf_dir):
    return keyworded(spark, sf_dir).search(words={"query": ["R", "5"], "operator": "or"})[1].ids()


@_add("search_text", _PLACES + "SELECT doc_id FROM s WHERE term = 'th'")
def _(spark, sf_dir):
    return texts(spark, sf_dir).search(text="th")[1].ids()


@_add("kw_normalized", f"SELECT o_orderkey FROM orders JOIN {_WORDS} ON o_orderkey = l_orderkey WHERE list_contains(words, 'R') AND list_contains(words, 'F')")
def _(spark, sf_dir):
    c = Catalog(keyworded(spark, sf_dir).documents, "o_orderkey")
    c["words"] = KeywordIndex("words", lambda w: F.lower(w), str.lower)
    return c["words"].all(["R", "f"]).execute().ids()


@_add("catalog_sort", _top("o_totalprice DESC, o_orderkey DESC", 40, "o_orderstatus = 'P'"))
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return ranked(c.sort(c.documents.where("o_orderstatus = 'P'"), "price", 40, reverse=True))


@_add("rs_one", "SELECT o_orderkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    c["key"] = FieldIndex("o_orderkey")
    least = c.documents.agg(F.min("o_orderkey").alias("k")).first()["k"]
    return spark.createDataFrame([(c["key"].eq(least).execute().one(resolve=False),)], "o_orderkey long")


@_add("rs_all", _top("o_totalprice, o_orderkey", 30, "o_orderstatus = 'P'"))
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    found = c["status"].eq("P").execute().sort(c["price"], limit=30).all(resolve=False)
    return spark.createDataFrame([(k, n) for n, k in enumerate(found, 1)], "o_orderkey long, rank long")


@_add("stream_upserts", "SELECT user_id, max_by(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def _(spark, sf_dir):
    """The last event of each user, kept by a stream."""
    at = scratch(spark)
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    rows.repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    table = DocumentTable(spark, f"{at}/table", "user_id", 8)
    table.follow(stream, "at", f"{at}/progress").awaitTermination()
    return table.current().select("user_id", "event_type")


@_add("query_catalog", _top("o_totalprice, o_orderkey", 100, "o_orderstatus = 'F' AND o_custkey > 10"))
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return ranked(c.query(c["status"].eq(Name("s")) & c["cust.key"].gt(10), "price", 100, names={"s": "F"})[1])


# enumeration and maintenance


@_add("unique_values", "SELECT DISTINCT o_orderpriority AS value FROM orders")
def _(spark, sf_dir):
    return orders(spark, sf_dir)["priority"].unique_values()


@_add("kw_unique_values", "SELECT DISTINCT unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS value FROM lineitem")
def _(spark, sf_dir):
    return keyworded(spark, sf_dir)["words"].unique_values()


@_add("word_count", "SELECT count(DISTINCT o_orderpriority) AS n FROM orders")
def _(spark, sf_dir):
    return spark.createDataFrame([(orders(spark, sf_dir)["priority"].word_count(),)], "n long")


@_add("indexed_counts", f"SELECT count(quality) AS indexed, count(*) - count(quality) AS not_indexed, count(*) AS docids FROM {_LABELS}")
def _(spark, sf_dir):
    i = labelled(spark, sf_dir)["quality"]
    return spark.createDataFrame([(i.indexed_count(), i.not_indexed_count(), i.docids_count())], "indexed long, not_indexed long, docids long")


@_add("upsert_docs", "SELECT o_orderkey, CASE WHEN o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'X' FROM orders WHERE o_custkey < 100 AND o_orderkey <> 0")
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    some = c.documents.where("o_custkey < 100").withColumn("o_orderstatus", F.lit("X"))
    return c.index_docs(some.unionByName(some.withColumn("o_orderkey", -F.col("o_orderkey")))).documents.select("o_orderkey", "o_orderstatus")


@_add("delete_docs", "SELECT o_orderkey FROM orders WHERE NOT (o_custkey < 100) AND o_orderstatus = 'F'")
def _(spark, sf_dir):
    c = orders(spark, sf_dir)
    return c.unindex_docs(c.documents.where("o_custkey < 100"))["status"].eq("F").execute().ids()


@_add("kw_text_mix", _PLACES + "SELECT doc_id FROM documents WHERE lang = 'fr' AND source <> 'src1' AND doc_id NOT IN (SELECT doc_id FROM s WHERE term = 'les')")
def _(spark, sf_dir):
    return labelled(spark, sf_dir).execute("origin == 'fr' and not (origin == 'src1') and 'les' not in text").ids()
