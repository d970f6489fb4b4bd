"""Each operator against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docgrove.llm import embeddings, fingerprints, licenses, line_dedup, lm_scoring, mixing, ngram_join, packing, quality, warc
from docgrove.llm.common import components, numbered
from docgrove.llm.edits import compare_next, edited

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", size string, target string, n_lines string, score string, labels string, copies string, length string, component_id string"


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = ["th", "er", "Of", "and", "été", "zu", "ñ", "ing", "日本"] + [f"w{i}" for i in range(60)]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 14))) for _ in range(6)]
    out = []
    for i in range(60):
        text = "\n".join([*[" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 4))], *rng.sample(lines, rng.randint(0, 3))])
        out.append([i, text])
    for i in range(60, 80):  # copies and near copies
        base = out[rng.randrange(20)][1]
        out.append([i, base if i % 3 else base.replace("th", "er", 1) + " tail"])
    out += [[80, None], [81, ""], [82, " \n\t "], [83, "one"], [84, "ONE"], [85, " ".join(f"word{i}" for i in range(9000))], [86, out[5][1]], [86, out[5][1]], [86, "other text of the same id"], [None, out[7][1]]]
    return [(d, t, None if (d or 0) % 11 == 0 else "en", None if (d or 0) % 13 == 0 else f"src{(d or 0) % 4}", len(t or "")) for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in corpus], DOC + CLASH).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_numbered_and_components(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "x long").repartition(7)
    got, n = numbered(df, ["x"], "at")
    assert n == 50 and all(r["x"] == r["at"] for r in got.collect())
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            part[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {x: find(x) for x in part}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_embeddings(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    base = rng.normal(size=(40, 16))
    rows = [[i, (base[i % 40] + rng.normal(size=16) * (0 if i % 5 == 0 else rng.uniform(0, 0.25))).tolist(), int(i % 3)] for i in range(240)]
    rows += [[240, None, 1], [241, [], 1], [242, [0.0] * 16, 1], [243, [math.nan] + [1.0] * 15, 1], [244, [None] + [1.0] * 15, 1], [245, rows[0][1], None], [246, [1e-30] * 16, 1], [247, [2e30] * 16, 1], [248, [1.0] * 8, 1], [249, [math.inf] * 16, 1]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(4)

    def unit(v):
        v = np.array([np.float32(x) for x in v], float)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    good = {r[0]: unit(r[1]) for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    links = {(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.93}
    assert (246, 247) in links
    got = {r["vec_id"]: r for r in embeddings.near_dups(df).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"vec_id", "n_links", "component_id", "kept"}
    n = Counter(x for p in links for x in p)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(n.values())
    assert all(r["n_links"] <= n[i] for i, r in got.items())
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(240, 246))
    # blocks give the same pairs
    vectors = spark.createDataFrame([(i, int(label[i]), v.tolist()) for i, v in good.items()], "node long, label int, embedding array<double>")
    some = {tuple(r) for r in embeddings.near_pairs(vectors, block=4).collect()}
    assert some == {tuple(r) for r in embeddings.near_pairs(vectors).collect()} and some <= links
    assert embeddings.near_dups(df.limit(0)).count() == 0


# 2


def test_lm_scores(spark, docs, corpus, empty):
    got = lm_scoring.score_documents(docs).collect()
    train = [t for d, t, *_ in corpus if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*words(t), None])
    total, kinds = sum(c.values()), len(c)
    want = Counter()
    for d, t, *_ in corpus:
        w = [*words(t), None]
        want[(d, zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_scoring.score_documents(empty).count() == 0


def test_attention_alone_beats_word_counts_on_held_out_texts(spark):
    """Where each word is followed by one of three, context tells more than counts; the mix keeps what either knows."""
    rng = random.Random(17)
    follow = {w: [rng.randrange(40) for _ in range(3)] for w in range(40)}
    rows = []
    for d in range(1200):
        w, text = rng.randrange(40), []
        for _ in range(rng.randint(60, 240)):
            text.append(f"{'abcdefgh'[w % 8]}{w}")
            w = rng.choice(follow[w])
        rows.append((d, " ".join(text)))
    got = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out").collect()
    base, alone, mixed = (sum(r[c] for r in got) / sum(r["n_tokens"] for r in got) for c in ("base_score", "attention_score", "score"))
    assert len(got) > 100 and alone > base + 0.3 and mixed > base + 0.3
    assert sum(r["attention_score"] > r["base_score"] for r in got) > 0.95 * len(got)


# 3


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ü x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c\r\nEvil: 1", ""), (5, "u", "single"), (6, "u", "x" * 300_000), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (None, "n", "<p>é</p>"), (8, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    folder, manifest = warc.write_archives(df, f"{tmp_path}/w")
    records = warc.resolve_revisits(warc.read_archives(folder, manifest)).collect()
    got = Counter((r["record_id"][11:], r["record_type"], r["refers_to"] and r["refers_to"][11:], r["response_length"], r["response_digest"]) for r in records)

    def row(page, html, kind, refers):
        b = (html or "").encode()
        return (str(page) if page is not None else "null", kind, refers and str(refers), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())

    p = "<p>é</p>"
    want = Counter([row(1, p, "revisit", 7), row(2, p, "revisit", 7), row(7, p, "response", None), row(7, p, "revisit", 7), row(None, p, "response", None), row(4, "", "response", None), row(3, "", "revisit", 4), row(5, "single", "response", None), row(6, "x" * 300_000, "response", None), row(8, "WARC/1.1\r\n\r\n", "response", None)])
    assert got == want
    assert {r["record_id"][11:]: r["payload"].decode() for r in records if r["record_type"] == "response"}["6"] == "x" * 300_000
    assert next(r["target_uri"] for r in records if r["record_id"].endswith(":4")) == "http://c%0D%0AEvil:%201"
    folder, manifest = warc.write_archives(df, f"{tmp_path}/w2", min_bytes=9)
    assert all(r["record_type"] == "response" for r in warc.read_archives(folder, manifest).where("payload_length < 9").collect())
    folder, manifest = warc.write_archives(df.limit(0), f"{tmp_path}/w3")
    assert warc.read_archives(folder, manifest).count() == 0


# 4


def test_mixing(spark, docs, corpus, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(corpus)
    size = Counter()
    for d, t, _, s, _ in corpus:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(size.values()), set(), {}
    while True:
        rest = total - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if target[s] > 2 * size[s] * (1 + 1e-12)}
        if not over:
            break
        full |= over
    taken, biggest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in names)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = Counter((r["doc_id"], r["size"]) for r in got for _ in range(r["copies"]))
    full_rows = mixing.mixed_documents(docs)
    assert full_rows.columns == docs.columns
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in full_rows.collect()) == copies
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_by_importance(spark):
    rows = [(i, "w " * 10, "s", float(i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, imp double")
    got = mixing.mix_sources(df, share=0.5, importance="imp").collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"] % 4].append(r["copies"])
    assert sum(r["taken"] for r in got) == pytest.approx(2000, abs=10) and sum(by[0]) == 0
    assert [sum(by[k]) / 100 for k in (1, 2, 3)] == pytest.approx([1 / 3, 2 / 3, 1], abs=0.12)


# 5


def test_cut_and_across():
    for n in range(1, 50):
        p = packing.cut(n, 8)
        assert [s for s, _ in p] == list(itertools.accumulate([0, *[k for _, k in p[:-1]]])) and sum(k for _, k in p) == n and all(k == 8 for _, k in p[1:])
    assert packing.across([(0, 1, 2), (1, 1, 1), (3, 3, 0)]) == [(1, 0, 1, 0, 1), (3, 0, 1, 1, 0), (3, 1, 1, 0, 0)]


@pytest.mark.parametrize("rows_per_range", [15, 10_000])
def test_best_fit(spark, rows_per_range):
    rng = random.Random(9)
    lengths = [rng.choice([1, 3, 5, 20, 33, 50, 64, rng.randint(1, 64)]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.best_fit(df, 64, rows_per_range).collect()
    assert sorted(r["item"] for r in got) == list(range(400))
    load = Counter()
    for r in got:
        assert r["length"] == lengths[r["item"]]
        load[r["seq"]] += r["length"]
    rooms, alone = [], 0  # best fit, one piece after the other, longest first
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        alone += k == len(rooms)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else 64) - n)
    assert max(load.values()) <= 64 and len(load) <= 1.02 * alone + 2
    assert packing.best_fit(df.limit(0), 64).count() == 0


def test_pack(spark, docs, corpus, empty):
    from docgrove.llm.bpe import encoder

    e = encoder().tokenizer
    got = packing.pack(docs, with_ids=True).collect()
    want = Counter()
    for d, t, *_ in corpus:
        ids = e.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            raw = np.array(ids[s : s + n], "<u4").tobytes()
            want[(d, k, s, n, zlib.crc32(raw), raw)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in rows.values():
        p.sort()
        assert [o for o, _ in p] == [0, *itertools.accumulate(n for _, n in p)][:-1] and sum(n for _, n in p) <= 2048
    assert packing.pack(empty).count() == 0


# 6


def test_lines(spark, docs, corpus, empty):
    def key(line):
        k = line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
        return k if len(k) >= 40 else None

    held = defaultdict(set)
    for d, t, *_ in corpus:
        for line in (t or "").split("\n"):
            if key(line):
                held[key(line)].add(d)
    gone = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= 5}
    assert gone
    want = Counter()
    for d, t, *_ in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == d]
        want[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()) == want
    assert line_dedup.dedup_lines(empty).count() == 0


# 7


def test_ngram_join(spark, docs, corpus, empty):
    sets = []
    for d, t, *_ in corpus:
        w = words(t)
        sets.append((d, frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()))
    n, part = Counter(), list(range(len(sets)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 60 * len(a | b):
            n[i] += 1
            n[j] += 1
            x, y = find(i), find(j)
            part[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(s), n[i], least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))
    got = ngram_join.near_documents(docs).collect()
    assert sum(n.values()) > 20
    assert Counter((r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in got) == want
    kept = Counter(r["doc_id"] for r in ngram_join.kept_documents(docs).collect())
    assert kept == Counter({d: 1 for d in least.values()} | {80: 1, 81: 1, 82: 1, None: 1})
    assert ngram_join.near_documents(empty).count() == 0


def test_ngram_join_on_random_near_copies(spark):
    rng = random.Random(8)
    rows = []
    for g in range(25):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(rng.randint(2, 80))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: frozenset(zip(t.split(), t.split()[1:])) for i, t in rows}
    links = Counter(x for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]) for x in (a, b))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for fragments in (1, 5):
        assert {r["doc_id"]: r["n_similar"] for r in ngram_join.near_documents(df, fragments=fragments).collect()} == {i: links[i] for i in sets}


def test_ngram_join_keeps_long_documents_with_equal_prints(spark, monkeypatch):
    # one range: some of 20,000 shingles share the 24 bits that tell shingles apart when they are counted
    monkeypatch.setattr(ngram_join, "RANGES", 1)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        w = [f"w{i}" for i in range(20_001)]
        df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:12_001])), (3, " ".join(w[:12_000]))], "doc_id long, text string")
        assert sorted(map(tuple, ngram_join.near_documents(df).select("doc_id", "n_shingles", "n_similar").collect())) == [(1, 20_000, 1), (2, 12_000, 2), (3, 11_999, 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


# 8


def test_fingerprints(spark, docs, corpus, empty):
    rows = sorted(((d, t or "") for d, t, *_ in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for ranges in (1, 6):
        got = sorted(compare_next(docs, ranges).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        want = Counter((d, len(t), hashlib.sha256(edited(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(rows))
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        for r in got:
            assert r["near_edited"] == pytest.approx(fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"]))
    assert compare_next(empty, 3).count() == 0
    one = compare_next(docs.where("doc_id = 83"), 4).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"one"[:2] + b"o").hexdigest()
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.add_fingerprints(docs.where("doc_id > 79")).collect()}
    assert plain[80] == plain[81] == plain[82] == "" and plain[83] == plain[84] != plain[85]


def test_likeness_is_unbiased():
    rng = random.Random(4)
    errors = []
    for share in (0.0, 0.3, 0.6, 0.9):
        for _ in range(40):
            a = [f"a{rng.random()}" for _ in range(150)]
            b = a[: int(150 * share)] + [f"b{rng.random()}" for _ in range(150 - int(150 * share))]
            sets = [set(zip(x, x[1:], x[2:])) for x in (a, b)]
            code, some = fingerprints.of_texts([" ".join(a), " ".join(b)])
            got = fingerprints.likeness_of(code[:1], some[:1], code[1:], some[1:])[0]
            errors.append(got - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.2
    assert fingerprints.likeness("", "") == 1.0 and fingerprints.likeness("", "AA==") == 0.0 and fingerprints.likeness(None, "") is None


# 9

MIT = "Copyright 2020 Ann\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"


def test_licenses(spark, docs, corpus, empty):
    extra = ["Released under the MIT License.", "see the mit\tLicense, or GNU General  Public License. GNU general public licenses", "Licensed under CC BY-NC 4.0.", MIT, MIT.replace("free of charge", "for a fee"), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "licensed under the terms of the GNU General Public License, version 3.0", "CC BY CC BÝ é", "mit license" * 2, None]
    rows = [(i, t) for i, t in enumerate([t for _, t, *_ in corpus] + extra)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, labels string, n_words string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows:
        w = [x.decode() for x in word.findall((t or "").encode().lower())]
        at = [(k, label) for phrase, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    k = len(corpus)
    assert [got[k + i]["labels"] for i in range(7)] == ["mit", "gpl,mit", "cc-by,cc-by-nc-4.0", "mit", "", "apache,apache-2.0", "gpl,gpl-3.0"]
    assert [got[k + i]["score"] for i in (0, 1, 3, 4)] == [1.0, 0.5, 1.0, 0.0]
    assert licenses.scan_licenses(empty).count() == 0


def labels_of(text):
    from docgrove.llm import spans as S
    import pyarrow as pa

    return licenses.scan(*S.flat(pa.array([text])))["labels"][0]


MIT_END = ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
CURL_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
CLEAR = "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE. "


def test_whole_licenses_match_to_their_end():
    assert labels_of(MIT + MIT_END) == labels_of("x\n" + MIT + MIT_END + " more") == labels_of(MIT) == "mit"
    assert labels_of(MIT + MIT_END.replace("IN NO EVENT", "IN ANY EVENT")) == labels_of(MIT + " and other terms") == ""
    assert (labels_of(ISC + ISC_END), labels_of(ISC + CURL_END), labels_of(ISC)) == ("isc", "", "")
    assert (labels_of(BSD + BSD_NAME + BSD_END), labels_of(BSD + BSD_END)) == ("bsd-3-clause", "bsd-2-clause")
    clear = BSD.replace("permitted", "permitted (subject to the limitations in the disclaimer below)")
    assert labels_of(clear + BSD_NAME + CLEAR + BSD_END) == labels_of(BSD + BSD_NAME + CLEAR + BSD_END) == labels_of(clear + BSD_NAME + BSD_END) == ""
    assert labels_of(BSD + BSD_END.replace("SUCH DAMAGE", "IT")) == labels_of(BSD + BSD_NAME) == ""


def test_standard_notices_and_plurals():
    notice = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for name, version, want in (("General Public License", 2, "gpl,gpl-2.0"), ("General Public License", 3, "gpl,gpl-3.0"), ("Lesser General Public License", 2.1, "lgpl-2.1"), ("Lesser General Public License", 3, "lgpl-3.0"), ("Affero General Public License", 3, "agpl-3.0")):
        assert labels_of(notice.format(name, version)) == want
    assert labels_of("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.") == "mpl-2.0"
    plural = BSD.replace("disclaimer in the", "disclaimers in the")
    assert labels_of(plural + BSD_END) == "bsd-2-clause" and labels_of(plural.replace("disclaimers", "notice") + BSD_END) == labels_of(plural.replace("disclaimers", "disclaimer s") + BSD_END) == ""


def test_automata():
    a = licenses.Automaton("x", "Copyright <<var;name=who;min=1;max=3>> may use<<beginOptional>> and<<beginOptional>> freely<<endOptional>> copy<<endOptional>> it")

    def accepts(text):
        return a.accepts(iter(licenses.words_of(text)))

    assert accepts("Copyright Ann, may use it.") == 5 and accepts("copyright a b c may use and freely copy it") and accepts("copyright a may use and copy it now") == 7
    assert not accepts("copyright may use it") and not accepts("copyright a b c d may use it") and not accepts("copyright a may use and freely it") and not accepts("copyright a may")
    for bad in ("<<beginOptional>>x", "x<<endOptional>>", "<<beginOptional>>x<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton("x", bad)


# 10


def test_quality(spark, empty):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "when", "from"]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 90)))
    bad = lambda: rng.choice([" ".join(w + "!!" for w in good().upper().split()), " | ".join(good().split()), " ".join([f"z{rng.random()}"] * 30)])
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(1000, None, "x"), (1001, "", "x"), (1, rows[1][1], "x"), (None, "a", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(5, None), (None, 1), (7, 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and got[1000]["score"] == got[1001]["score"]
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs.repartition(7), quality.fit(docs.repartition(5), labels)).collect()}
    assert all(again[i] == pytest.approx(r["score"]) for i, r in got.items())
    assert quality.classify(empty, quality.fit(empty, labels)).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}


def test_quality_scores_are_those_of_averaged_vectors():
    from docgrove.llm import spans as S
    import pyarrow as pa

    data, offsets = S.flat(pa.array(["the the quick fox", "", "été | été |", "x"]))
    rng = np.random.Generator(np.random.PCG64(1))
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    ids, share, border = quality.features(data, offsets)
    want = [1 / (1 + math.exp(-(float((model.effect[ids[a:b]] * share[a:b]).sum()) + 0.3))) for a, b in zip(border, border[1:])]
    assert model.scores(data, offsets) == pytest.approx(want, abs=1e-5)


def test_whole_licenses_match_reflowed_and_no_other_word():
    """A reflowed copy in other text is accepted; with one word changed, left out or added it isn't."""
    rng = random.Random(12)

    def labels(text):
        b = np.frombuffer(text.encode(), np.uint8)
        return set(licenses.scan(b, np.array([0, len(b)]), phrases=())["labels"][0].split(",")) - {""}

    whole = {x: licenses.words_of(re.sub("<<[^>]*>>", " ", licenses.whole_license(x))) for x in licenses.WHOLE}
    for template, label in ((licenses._BSD + " " + licenses._BSD_DISCLAIMER, "bsd-2-clause"),):
        whole[label] = licenses.words_of(re.sub("<<var;name=(holder|liable)[^>]*>>", " the authors ", re.sub("<<var;name=disclaimer[^>]*>>", " disclaimer ", re.sub("<<(begin|end)[^>]*>>", " ", template))).replace("<<var;name=bullet1;min=0;max=1>>", "1").replace("<<var;name=bullet2;min=0;max=1>>", "2"))
    for label, w in whole.items():
        said = [x.upper() if rng.random() < 0.3 else x for x in w]
        text = "Some words before. " + "".join(x + rng.choice([" ", "\n", ", ", "\n\n * ", " - "]) for x in said) + " and after"
        assert label in labels(text), label
        for _ in range(3):
            k = rng.randrange(40, len(w) - 1)
            for part in (["otherwise"], [], [w[k], "otherwise"]):
                if part or w[k] != w[k + 1]:
                    assert label not in labels(" ".join([*w[:k], *part, *w[k + 1 :]])), (label, k, part)


OWN = ", _id string, _doc string, _k string, _loose string, _rank string, _drops string, _item string, _read string, _scanned string, _size string, _u string, _q string, _copy string, name string, block string, node string"


def test_columns_named_like_the_operators_own(spark, corpus):
    """Operators that carry columns through keep those that are named as theirs are inside."""
    df = spark.createDataFrame([(*r, *["x"] * 16) for r in corpus[:40]], DOC + OWN).repartition(3)
    n = df.count()
    for got in (line_dedup.dedup_lines(df), licenses.scan_licenses(df), quality.classify(df, quality.Model(np.zeros(quality.BUCKETS, np.float32), 0.0))):
        assert set(df.columns) <= set(got.columns)
        rows = got.collect()
        assert len(rows) == n and all(r[c] == "x" for r in rows for c in OWN.replace(", ", " ").split()[::2])
    for got in (ngram_join.kept_documents(df), mixing.mixed_documents(df, by_size=True)):
        assert got.columns == df.columns and all(r["_id"] == "x" for r in got.collect())
    assert packing.pack(df).select("doc_id").distinct().count() == n


def test_near_copies_through_blocks_of_hot_shingles(spark, monkeypatch):
    """A prefix shingle that many sets hold is cut into blocks of any size, and links stay."""
    rng = random.Random(21)
    rows = [(i, " ".join(f"common{k}" for k in range(rng.randint(6, 9))) + " " + " ".join(f"x{rng.randrange(5)}" for _ in range(4))) for i in range(90)]
    sets = {i: frozenset(zip(t.split(), t.split()[1:])) for i, t in rows}
    links = Counter(x for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]) for x in (a, b))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "UNIT_CLASSES", 1 << 18)
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", 64)
    assert sum(links.values()) > 100
    assert {r["doc_id"]: r["n_similar"] for r in ngram_join.near_documents(df).collect()} == {i: links[i] for i in sets}


def test_bitmaps_never_drop_a_close_pair():
    rng = np.random.Generator(np.random.PCG64(31))
    sets = []
    for n in (1, 2, 5, 40, 41, 300, 700):
        base = np.unique(rng.integers(0, 2**63, n, np.uint64)) << np.uint64(8)
        sets += [base, base[: max(1, int(n * 0.6))], base[: max(1, int(n * 0.8))], np.concatenate([base[: max(1, n // 2)], np.unique(rng.integers(0, 2**55, n, np.uint64)) << np.uint64(8)])]
    sets = [np.unique(x) for x in sets]
    sizes = np.array([len(x) for x in sets])
    maps = ngram_join.bitmaps(np.concatenate(sets), sizes)
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    ok = ngram_join.close_pairs(i, j, maps, maps, sizes, sizes, 60)
    linked = np.array([100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert ok[linked].all() and not ok.all()


def test_components_in_rounds(spark, monkeypatch):
    """More edges than one task takes: rounds of stars, with a hub, a chain and many small parts."""
    from docgrove.llm import common

    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1100)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    want = {}
    nodes, roots = common._roots(*(np.array(x, np.int64) for x in zip(*[e for e in edges if e[0] != e[1]])))
    want = dict(zip(nodes.tolist(), roots.tolist()))
    assert want[150] == 0 and want[1100] == 1000
    monkeypatch.setattr(common, "FOREST_EDGES", 50)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == want


def test_pieces_that_open_sequences_are_as_many_as_needed(spark):
    """Few equal pieces fill as few sequences as can hold them."""
    for n, length in ((1, 6), (10, 6), (60, 200), (64, 200), (65, 200), (100, 7)):
        got = packing.best_fit(spark.createDataFrame([(i, length) for i in range(n)], "item long, length long"), 2048)
        assert got.select("seq").distinct().count() == -(-n // (2048 // length)), (n, length)
    rows = spark.range(5000).selectExpr("id AS item")
    for n in (1, 17, 4999, 5000):
        assert rows.where(packing.exactly(rows, n, 5000)).count() == n


def test_the_tokenizers_special_string(spark):
    """A special token's string has that token's id, as in the tokenizer's own call."""
    from tokenizers import Tokenizer

    from docgrove.llm.bpe import vocabulary_path

    e = Tokenizer.from_file(vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>'s", "<|endoftext", "|>", "  <|endoftext|>\n\n a", "it'<|endoftext|>s"]
    got = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), with_ids=True).collect()
    assert 50256 in e.encode(texts[0], add_special_tokens=False).ids
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*e.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], texts[r["doc_id"]]


def test_mixing_by_size_samples_as_often_as_it_says(spark):
    """Over seeds, documents are taken as often as their inclusion probabilities say, longer ones more often."""
    rows = [(i, "w " * (5 + 5 * (i % 8)), "s") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    total, runs, taken = sum(5 + 5 * (i % 8) for i in range(160)), 4, Counter()
    for seed in range(runs):
        got = mixing.mix_sources(df, share=0.4, seed=seed, by_size=True).collect()
        assert abs(sum(r["taken"] for r in got) - 0.4 * total) <= 40
        for r in got:
            taken[r["size"]] += r["copies"]
    rate = 0.4 * total / sum((5 + 5 * (i % 8)) ** 2 for i in range(160))
    for size in range(5, 45, 5):
        p = rate * size
        assert taken[size] / (20 * runs) == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / (20 * runs)) + 0.02)


def test_mixing_takes_part_of_rows_that_are_alike(spark):
    df = spark.createDataFrame([(None, "w w w w", "s")] * 1000 + [(1, "w", "t")], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, share=0.83, limit=2.0).collect()
    target = {r["source"]: r["target"] for r in got}
    assert abs(sum(r["taken"] for r in got if r["source"] == "s") - target["s"]) <= 4
    assert mixing.mixed_documents(df, share=0.83).where("source = 's'").count() * 4 == pytest.approx(target["s"], abs=4)
