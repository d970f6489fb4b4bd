"""Times the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

HEADLINE = ["cqe_range", "field_inrange", "kw_all", "facet_counts", "sort_asc", "sort_desc", "text_term", "text_and", "text_phrase", "text_glob", "sort_relevance", "text_and_field", "search_legacy"]


def main() -> None:
    from pyspark.sql import SparkSession

    from docgrove.queries import QUERIES, texts
    from docgrove.sources.folders import scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    began = time.time()
    cached = texts(spark, sf_dir).cache()
    n = cached.frame().count()
    took["ingest_analyse_and_cache"] = round(time.time() - began, 3)
    runs = {name: (lambda q=QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    for name, query in (("cached_one_word_top10", "th"), ("cached_two_words_top10", "th er")):
        runs[name] = lambda query=query: cached["text"].contains(query).execute().sort(cached["text"], limit=10).rows.collect()
    began = time.time()
    stored = texts(spark, sf_dir)
    stored["text"].store(f"{scratch(spark)}/text")
    took["ingest_store_postings"] = round(time.time() - began, 3)
    for name, query in (("stored_one_word_top10", "th"), ("stored_two_words_top10", "th er"), ("stored_phrase_top10", '"th er"'), ("stored_glob_top10", "tha*")):
        runs[name] = lambda query=query: stored["text"].contains(query).execute().sort(stored["text"], limit=10).rows.collect()
    kept = texts(spark, sf_dir)
    kept["text"].open(stored["text"].kept.folder.path).kept.cache().postings(["th"]).count()
    for name, query in (("kept_one_word_top10", "th"), ("kept_two_words_top10", "th er")):
        runs[name] = lambda query=query: kept["text"].contains(query).execute().sort(kept["text"], limit=10).rows.collect()
    for name, run in runs.items():
        run()
        times = []
        for _ in range(3):
            t = time.time()
            run()
            times.append(time.time() - t)
        took[name] = round(statistics.median(times), 3)
    took["ingest_docs_per_s"] = round(n / took["ingest_analyse_and_cache"], 1)
    print(json.dumps({"metric": "headline_total", "value": round(sum(v for k, v in took.items() if k != "ingest_docs_per_s"), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
