"""The training-data operators on awkward rows: against brute force, exact round trips, SQL, or held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from quire.llm import bitplanes, jaccard, langid, mixing, packing, pseudolm, queries, rules, sitebayes, tokens, vectors, warc
from quire.llm.components import components
from quire.llm.workspace import fresh_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names clash with those that operators make.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, tie bigint, start bigint, cells string, pattern string, evidence double"


def awkward() -> list[tuple]:
    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta."]) + str(rng.randrange(40)) for _ in range(n)) for n in (60, 120, 120, 300)]
    texts = [None, "", "   ", "one", "two words", "!!! ???", "a\tb\x0bc  d\n\n e", base[0], base[0], base[0].upper(), base[1], base[1] + " tail", base[2], base[3] * 40, "ß " * 200, "数字 漢字 123", "<|endoftext|> x", "same line\nsame line\nother " + base[0]]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "", None)[i % 4], None, 1, 2, 3, "x", "y", 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, base[1], None, None, None, 1, 2, 3, "x", "y", 0.5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library_ids(text):
    return tokens.encoder(tokens.default_vocabulary())._tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_is_the_library():
    rng = random.Random(1)
    signs = [" ", " ", "  ", "\n", "\t", "a", "don't", "'s", "12", "é", "÷", "\xa0", "　", "!?", "<|endoftext|>", "\x85", "漢字", "\r\n", "😀", "½"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(3000)] + [None]
    flat, at = tokens.encoder(tokens.default_vocabulary()).encode(texts)
    assert all(flat[a:b].tolist() == library_ids(t) for a, b, t in zip(at[:-1], at[1:], texts, strict=True))


def test_packing(docs, empty):
    vocabulary = tokens.default_vocabulary()
    got = packing.pack_documents(docs, vocabulary, capacity=64, group_docs=8).toPandas()
    want = Counter((r[0], crc([*library_ids(r[1]), 1])) for r in awkward())
    whole = Counter()
    for (doc, total), part in got.assign(doc_id=got.doc_id.fillna(-1)).groupby(["doc_id", "doc_tokens"]):
        part = part.sort_values(["start"])
        times = int((part.start == 0).sum())
        ids = b"".join(part.drop_duplicates("start").ids)
        assert len(ids) == 4 * total and part.length.sum() == times * total
        whole[(None if doc == -1 else doc, zlib.crc32(ids))] += times
    assert whole == want
    placed = got.sort_values(["sequence_id", "offset"])
    assert ((placed.offset + placed.length).groupby(placed.sequence_id).shift().fillna(0) == placed.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 64
    assert packing.pack_documents(empty, vocabulary).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 65, 300))[::-1]
    bins, _ = packing.first_fit_decreasing(lengths, 64)
    free: list[int] = []
    for n, got in zip(lengths.tolist(), bins.tolist(), strict=True):
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(64)
        free[at] -= n
        assert at == got


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(spark, docs, empty, bits):
    for n in (1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype(np.uint32)
        assert (bitplanes.join_planes(bitplanes.split_planes(ids, bits), n) == ids).all()
    folder, manifest = bitplanes.encode_to_files(docs, tokens.default_vocabulary(), bits=bits)
    got = bitplanes.read_ids(spark, folder, manifest).toPandas().sort_values("start")
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = [crc([*library_ids(r[1]), 2]) for r in rows]
    assert got.ids_crc32.tolist() == want and (got.start + got.n_tokens).tolist()[:-1] == got.start.tolist()[1:]
    folder, manifest = bitplanes.encode_to_files(empty, tokens.default_vocabulary())
    assert manifest == [] and bitplanes.read_ids(spark, folder, manifest).count() == 0


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, num, den):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    least = {i: i for i, _ in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies():
    rng = random.Random(9)
    out = []
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([12, 40, 200]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard(spark, docs, empty, monkeypatch, width, num, den):
    rows = near_copies()
    monkeypatch.setattr(jaccard, "SMALL", 6)
    if num != 90:  # rounds of pivots, parts and tiles of hot regions
        for name, value in (("SPLIT_DOCS", 4), ("PIVOTS", 2), ("MAX_ROUNDS", 2 if num == 80 else 4), ("PAYS", 9.0 if num == 80 else 0.7), ("REGION_DOCS", 5), ("PART_DOCS", 3), ("BROADCAST_ROWS", 5)):
            monkeypatch.setattr(jaccard, name, value)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), width, num, den).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute_components(rows, width, num, den)
    if num == 90:
        got = jaccard.jaccard_components(docs, width, num, den).toPandas()
        plain = [(r[0], r[1]) for r in awkward()[:-2]]
        assert {int(r.doc_id): (r.n_shingles, int(r.component_id)) for r in got.dropna().itertuples()} == brute_components(plain, width, num, den)
        assert got.component_id.isna().sum() == 1 and jaccard.jaccard_components(empty, width, num, den).count() == 0


def test_repeated_and_null_ids_are_judged_by_their_own_text(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (5, a + " tail"), (5, b), (3, c), (5, c + " end"), (None, d), (None, d), (7, d + " x"), (9, e), (9, e), (None, b + " y"), (11, ""), (11, ""), (None, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table, 5, 80, 100).collect())
    of = [1, 1, 5, 3, 3, None, None, 7, 9, 9, None, 11, 11, None]
    assert got == Counter((i, len(shingle_set(t, 5)), o) for (i, t), o in zip(rows, of, strict=True))
    kept = Counter(tuple(r) for r in jaccard.one_of_each(table, 5, 80, 100).collect())
    assert kept == Counter([(1, a), (5, b), (3, c), (7, d + " x"), (9, e), (11, ""), (11, ""), (None, None)])
    assert Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, table, SF).collect()) == kept


def test_cells_meet_as_in_a_plain_reading(spark):
    """Nodes far apart and negative, with frequent cells, and documents without cells."""
    rng = random.Random(21)
    rows = [(rng.choice([-1, 1]) * rng.randrange(1 << rng.choice([8, 40, 62])), [rng.randrange(-(2**63), 2**63) if rng.random() < 0.9 else rng.randrange(40) for _ in range(rng.choice([0, 1, 300]))]) for _ in range(300)]
    rows = list(dict(rows).items())
    of = {}
    for node, cells in rows:
        for c in cells:
            of.setdefault(c, set()).add(node)
    table = spark.createDataFrame(rows, "node bigint, cells array<bigint>")
    got = Counter(tuple(r) for r in jaccard._shared(table).collect())
    assert got == Counter({(min(x), n) for x in of.values() if len(x) > 1 for n in x})
    assert jaccard._shared(table.where("size(cells) = 0")).count() == 0


def test_near_duplicates_shuffle_little(spark):
    """Cells are many times as many as the documents, and a set is larger than its text."""
    rng = random.Random(22)
    texts = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(600))) for i in range(300)]
    rows = texts + [(900 + i, t + " end") for i, t in texts[:150]]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80, 100).count() == 300
    assert written() - before < 2 * sum(len(t) for _, t in rows)


def test_voronoi_loses_no_link(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    sets = [np.unique(np.array([hash(s) & 0xFFFFFFFF for s in shingle_set(t, 2)], dtype=np.uint64)) for _, t in near_copies()]
    links = jaccard.spanning(jaccard.voronoi_links(sets, 80, 100), len(sets))
    common, size = jaccard.intersections(sets), np.array([len(s) for s in sets])
    i, j = np.nonzero(np.triu(100 * common >= 80 * (size[:, None] + size[None] - common), 1))
    assert links == jaccard.spanning(list(zip(i.tolist(), j.tolist(), strict=True)), len(sets))


def families():
    """Thirty families of twenty near copies with a little in common, and for each a text that shares two fifths of it."""
    rng = random.Random(12)
    fresh = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    shared, out, halves = fresh(20), [], []
    for _ in range(30):
        own = shared + fresh(220)
        for _ in range(20):
            w = list(own)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
        halves.append(" ".join(own[:100] + fresh(140)))
    return list(enumerate(out + halves))


def test_windows_decide_at_the_default_settings(spark):
    rows = families()
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    log = []
    plain, classes = jaccard._linked(table, 3, 90, 100, log)
    got = plain.join(classes, ["fp1", "fp2"]).toPandas()
    assert {r.doc_id: (r.n_shingles, r.of) for r in got.itertuples()} == brute_components(rows, 3, 90, 100)
    # distances to pivots settle many regions and windows thin the others; what is left goes to the leaves
    assert log[0]["open"] < log[0]["members"] and log[0]["measured"] < log[0]["members"], log


def test_voronoi_round_routes_by_windows():
    """Every close pair meets in the home of one of the two, and most routes are closed."""
    sets = [np.unique(np.array([hash(s) & 0xFFFFFFFF for s in shingle_set(t, 3)], dtype=np.uint64)) for _, t in families()]
    pivots = list(range(0, 400, 50))
    part = {"region": [7] * (len(sets) + 8), "part": [0] * (len(sets) + 8), "pivot": [False] * len(sets) + [True] * 8, "node": [*range(len(sets)), *pivots], "values": [x.tobytes() for x in [*sets, *(sets[p] for p in pivots)]]}
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(part.values(), kinds, strict=True)], names=list(part))
    out = pa.Table.from_batches(jaccard._split(90, 100)([batch])).to_pylist()
    into = {}
    for r in out:
        into.setdefault(r["node"], set()).add(r["region"])
    assert len(out) < 3 * len(sets) and any(r["outer"] for r in out) and any(len(x) > 1 for x in into.values())
    common, size = jaccard.intersections(sets), np.array([len(s) for s in sets])
    i, j = np.nonzero(np.triu(100 * common >= 90 * (size[:, None] + size[None] - common), 1))
    assert len(i) > 1000 and all(into[a] & into[b] for a, b in zip(i.tolist(), j.tolist(), strict=True))


def test_sparse_sets_meet_in_no_cell_by_their_empty_slices():
    rng = np.random.default_rng(5)
    for n in (10, 20, 40, 60):
        seen = Counter(k for _ in range(3000) for k in set(jaccard.cell_keys(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)), 80, 100).tolist()))
        assert max(seen.values()) == 1


def test_components_of_a_long_path(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 101), (None, 3), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_language(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(table)
    got = langid.predict_languages(table, model).toPandas().merge(table.toPandas(), on="doc_id")
    out = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)]
    assert len(out) > 30 and (out.lang == out.lang_pred).mean() > 0.95
    rows = langid.predict_languages(docs, model).toPandas()
    assert len(rows) == len(awkward()) and rows.score.between(0, 1).all()
    bare = {r[0] for r in awkward() if r[0] is not None and not any(c.isalpha() for c in r[1] or "")}
    assert set(rows[rows.lang_pred == "und"].doc_id) == bare
    none = langid.train(empty)
    assert none.langs == [] and set(langid.predict_languages(docs, none).toPandas().lang_pred) == {"und"}
    assert langid.keep_known(docs, model, 0.0).columns == docs.columns


def test_language_of_pieces_is_that_of_the_whole(spark, monkeypatch):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [r[1] for r in awkward()] + ["  Ab1 \n" * 30, "é" * 50, " ", "a"]
    langs, scores = model.predict(texts)
    counted = langid.grams(texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(langid, "LONG", size)
        again, other = model.predict(texts)
        assert again == langs and np.allclose(scores, other)
    for i, t in enumerate(texts):
        if t:
            span = counted.chars[counted.start[i] : counted.end[i]]
            want = [Counter(langid.Grams(span, None, None, None).buckets(k).tolist()) for k in langid.ORDERS]
            got = [Counter() for _ in langid.ORDERS]
            for k, b, _ in langid.long_grams(t):
                got[k].update(b.tolist())
            assert got == want


def test_language_is_naive_bayes(spark):
    """Counts, probabilities and the choice against a plain reading."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("das ist ein Haus", "de"), ("this is a house", "en"), ("Das Boot, das!", "de"), ("a boat is", "en")] * 6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    plain = lambda t: re.sub(r"[^a-z]+", " ", t.lower()).lstrip()
    bucket = lambda g: int(langid.Grams(np.array([ord(c) for c in g], dtype=np.uint32), None, None, None).buckets(len(g))[0])
    for text in ("ein Boot", "is a boat house", "x"):
        total = {}
        for lang in ("de", "en"):
            total[lang] = math.log(sum(r[2] == lang for r in learnt) / len(learnt))
            for order in langid.ORDERS:
                n = Counter(bucket(p[k : k + order]) for r in learnt if r[2] == lang for p in [plain(r[1])] for k in range(len(p) - order + 1))
                p = plain(text)
                total[lang] += sum(math.log((n[bucket(p[k : k + order])] + 0.5) / (sum(n.values()) + 0.5 * langid.BUCKETS)) for k in range(len(p) - order + 1))
        (got,), (score,) = model.predict([text])
        assert got == max(total, key=total.get)
        if 3 * len(plain(text)) - 3 <= langid.SCORED_GRAMS:
            assert math.isclose(score, 1 / (1 + math.exp(min(total.values()) - max(total.values()))), rel_tol=1e-4)


def mix_reference(rows, weights, share, most):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    open_, left, target = set(order), Fraction(sum(sizes.values())) * share, {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        for s in over or list(open_):
            target[s] = Fraction(most * sizes[s]) if over else left * weight[s] / total
        open_ -= set(over or open_)
        left -= sum(target[s] for s in over)
    return sizes, target


@pytest.mark.parametrize("sources", [0, 1 << 20])
def test_mixing(spark, docs, empty, monkeypatch, sources):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    monkeypatch.setattr(mixing, "RANGE_DOCS", 3)
    got = mixing.mix_sources(docs, [3, 1, 2]).toPandas()
    sizes, target = mix_reference(awkward(), [3, 1, 2], Fraction(3, 2), 2)
    for source, part in got.groupby("source", dropna=False):
        source = None if pd.isna(source) else source
        assert math.isclose(part.target.iloc[0], float(target[source])) and part.source_size.iloc[0] == sizes[source]
        assert part.taken.sum() == math.floor(part.target.iloc[0]) and (part.taken <= 2 * part["size"]).all()
    assert len(got) == len(awkward()) and mixing.mix_sources(empty, [3, 1, 2]).count() == 0
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    mine = queries.op6_mixing(spark, SF).toPandas()[names].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(mine, con.sql(mixing.mix_sql([3, 1, 2])).df()[names].sort_values("doc_id").reset_index(drop=True), check_dtype=False)


def test_rules(docs, empty):
    got = rules.judge(docs).toPandas().sort_values("doc_id", na_position="last").reset_index(drop=True)
    for r, row in zip(sorted(awkward(), key=lambda r: (r[0] is None, r[0] or 0)), got.itertuples(), strict=True):
        text = r[1] or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if three[tuple(w[i : i + 3])] > 1}
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (row.kept and row.base_failed)
    assert rules.judge(empty).count() == 0 and rules.keep_good(docs).columns == docs.columns


def test_rules_find_junk(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = rules.judge(table).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas()[["doc_id", "quality"]].rename(columns={"quality": "good"}), on="doc_id")
    fine = got[~got.base_failed]
    assert (fine.kept == (fine.good == 1)).mean() > 0.95


def pages_fixture():
    big = "<p>" + "ü" * 600 + "</p>"
    return [(1, "http://www.B.example/x?q=1#f", big), (2, "https://a.example:8080/", big), (5, None, big), (None, "http://a.example/", big), (3, "http://a.example/\r\nX: y", "small"), (4, "", None), (5, "http://a.example/", big), (6, "http://[bad", "small")]


@pytest.mark.parametrize("digests", [0, 1 << 20])
def test_warc(spark, monkeypatch, digests):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", digests)
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "SPARSE", 2)
    pages = spark.createDataFrame(pages_fixture(), "page_id bigint, url string, html string").repartition(5)
    got = warc.archive_round_trip(pages).toPandas()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(warc.warc_sql()).df()
    show = lambda f: sorted(str(tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r)) for r in f[list(want.columns)].itertuples(index=False, name=None))
    assert show(got) == show(want) and (got.record_type == "revisit").sum() == 3
    placed = got.sort_values(["index_part", "index_row"])
    order = list(zip(placed.url_key, placed.captured, placed.page_id.fillna(-1), strict=True))
    assert order == sorted(order)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in range(7):
        runs = [sorted((rng.randrange(30),) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(5):
        centre = rng.standard_normal(32)
        rows += [((centre + rng.standard_normal(32) * s).tolist(), g % 2) for s in rng.uniform(0, 0.3, 40)]
    rows += [(rows[0][0], 0), (rows[0][0], None), ((np.array(rows[1][0]) * 7).tolist(), 0), ([0.0] * 32, 0), ([float("nan")] + [1.0] * 31, 0), ([None] + [1.0] * 31, 0), ([float("inf")] * 32, 0), ([], 0), (None, 0), ([1.0, 2.0], 0), ([1.0, 2.0], 0)]
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("cell_rows", [4000, 16])
def test_vectors(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vectors, "CELL_AIM", 20)
    rows = vector_rows()
    got = vectors.vector_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), 0.98).toPandas().set_index("vec_id")
    unit = {}
    for i, e, label in rows:
        if e and label is not None and None not in e and np.isfinite(e).all() and np.any(e):
            unit[i] = (label, np.array(e) / np.linalg.norm(e))
    links = {(a, b) for a in unit for b in unit if a != b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98}
    assert len(links) > 100
    n = Counter(a for a, _ in links)
    assert {i: int(got.n_links[i]) for i, *_ in rows} == {i: n[i] for i, *_ in rows}
    least = {i: i for i, *_ in rows}
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert {i: int(got.component_id[i]) for i, *_ in rows} == least
    assert (got.kept == (got.component_id == got.index)).all()
    assert vectors.vector_links(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"), 0.98).count() == 0


def test_vectors_of_a_repeated_id_are_judged_by_themselves(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.standard_normal((3, 32))
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, (a + 0.001).tolist(), 0), (5, c.tolist(), 0), (1, c.tolist(), 1), (9, (c * 2).tolist(), 1), (9, (c * 2).tolist(), 1)]
    got = Counter(tuple(r) for r in vectors.vector_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), 0.98).collect())
    assert got == Counter([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (5, 0, 5, True), (1, 2, 1, True), (9, 2, 1, False), (9, 2, 1, False)])


def test_site_quality(spark, docs, empty):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    got = queries.op5_site_quality(spark, SF).toPandas().merge(labels.toPandas(), on="doc_id")
    assert len(got) and (got.kept == (got.quality == 1)).mean() > 0.9
    none = labels.limit(0)
    rows = sitebayes.site_quality(docs, none, F.col("source"), F.col("lang")).toPandas()
    assert len(rows) == len(awkward()) and (rows.posterior - 0.5).abs().max() < 1e-9
    assert sitebayes.site_quality(empty, labels, F.col("source"), F.col("lang")).count() == 0
    assert table.count() == queries.op5_site_quality(spark, SF).count()


def test_pseudo_likelihood(spark, docs, empty):
    rng = random.Random(6)
    cycle = [f"t{i}" for i in range(12)]
    ordered = [(i, " ".join(cycle[(i + k) % 12] for k in range(400))) for i in range(120)]
    broken = [(1000 + i, " ".join(rng.choice(cycle) for _ in range(400))) for i in range(20)]
    table = spark.createDataFrame(ordered + broken, "doc_id bigint, text string")
    model = pseudolm.train(table)
    got = pseudolm.score_documents(table, model).toPandas()
    assert got[got.doc_id < 1000].mean_score.min() > got[got.doc_id >= 1000].mean_score.max()
    assert (got.n_tokens == 400).all() and (got.score < 0).all()
    rows = pseudolm.score_documents(docs, model).toPandas()
    assert len(rows) == len(awkward()) and (rows.mean_score.isna() == (rows.n_tokens == 0)).all()
    assert pseudolm.score_documents(empty, pseudolm.train(empty)).count() == 0


def test_words_of_a_shared_class_score_by_their_own_counts(spark):
    often, rare = [f"own{i}" for i in range(pseudolm.OWN)], [f"rare{i}" for i in range(1500)]
    times = {w: 1 + i % 5 for i, w in enumerate(rare)}
    corpus = [(i, " ".join(often[k : k + 64])) for i in range(12) for k in range(0, pseudolm.OWN, 64)] + [(99, " ".join(w for w in rare for _ in range(times[w])))]
    model = pseudolm.train(spark.createDataFrame(corpus, "doc_id bigint, text string"))
    assert model[4].count() == len(often) + len(rare)
    asked = rare + [f"unseen{i}" for i in range(300)]
    by_class = dict(zip(asked, pseudolm.classes_of(np.concatenate([pseudolm.words([w.encode()], lower=True).hash for w in asked]), *model[1:3]).tolist(), strict=True))
    got = pseudolm.score_documents(spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "doc_id bigint, text string"), model).toPandas()
    score = {asked[r.doc_id]: r.score for r in got.itertuples()}
    for c in set(by_class.values()):
        alike = [w for w in asked if by_class[w] == c]
        for w in alike[1:]:
            assert math.isclose(score[w] - score[alike[0]], math.log((times.get(w, 0) + 1) / (times.get(alike[0], 0) + 1)), abs_tol=1e-6)
        inside = [w for w in rare if by_class[w] == c]
        assert model[3][c] == sum(times[w] + 1 for w in inside) + 1
    twice = pseudolm.score_documents(spark.createDataFrame([(1, "rare4 own1"), (2, "rare4 own1 rare4 own1")], "doc_id bigint, text string"), model).toPandas().set_index("doc_id")
    assert twice.n_tokens.to_dict() == {1: 2, 2: 4} and twice.score[2] < twice.score[1]


def test_words_meet_their_counts_in_few_bytes(spark):
    """Where counts are too many to broadcast, less than the text crosses the shuffle; scores are the sums of what each word costs."""
    rng = random.Random(23)
    texts = [(i, " ".join(f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(400))) for i in range(400)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = pseudolm.train(table)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.score for r in pseudolm.score_documents(table, model).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert written() - before < 0.9 * sum(len(t) for _, t in texts), (written() - before) / sum(len(t) for _, t in texts)
    flat, vocabulary, rank, sizes, _ = model
    times, p = Counter(w for _, t in texts for w in t.split()), pseudolm.unflatten(flat)
    for i, t in texts[::40]:
        ids = pseudolm.classes_of(pseudolm.words([t.encode()], lower=True).hash, vocabulary, rank)
        laid, place = pseudolm._laid(ids, np.zeros(len(ids), dtype=np.int64))
        logs = pseudolm.log_probability(p, pseudolm._around(laid, place), ids)
        inside = [math.log((times[w] + 1) / sizes[c]) if c >= pseudolm.OWN else 0 for w, c in zip(t.split(), ids.tolist(), strict=True)]
        assert math.isclose(got[i], logs.sum() + sum(inside), rel_tol=1e-6)


def test_every_position_is_trained_on_once(monkeypatch):
    """Also those of documents of one to four words."""
    seen = []
    monkeypatch.setattr(pseudolm.Trainer, "step", lambda self, context, target: seen.extend(target.tolist()))
    texts = [" ".join(f"d{n}w{i}" for i in range(n)) for n in (1, 2, 3, 4, 5, 17, 3000)]
    hashes = np.unique(np.concatenate([pseudolm.words([x.encode()], lower=True).hash for x in texts]))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    weight = 0
    for turn in range(pseudolm.ROUNDS):
        weight += sum(b.column("weight")[0].as_py() for b in pseudolm._parameters(pseudolm.flatten(pseudolm.initial()), hashes, np.arange(len(hashes)), turn)([batch]))
    assert weight == len(hashes) == sum(len(x.split()) for x in texts)
    assert sorted(seen) == list(range(len(hashes)))


def test_kernels_of_the_window_network_are_the_plain_reading():
    rng = np.random.default_rng(4)
    vocabulary, rank = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64)), rng.permutation(3000)
    assert len(np.unique(vocabulary & np.uint64((1 << pseudolm.SLOT_BITS) - 1))) < 3000  # some slots are shared
    hashes = rng.permutation(np.concatenate((vocabulary, rng.integers(0, 1 << 63, 4000).astype(np.uint64))))
    own = dict(zip(vocabulary.tolist(), rank.tolist(), strict=True))
    assert all(c == own[h] if h in own else c >= pseudolm.OWN for h, c in zip(hashes.tolist(), pseudolm.classes_of(hashes, vocabulary, rank).tolist(), strict=True))
    doc = np.repeat(np.arange(200), rng.integers(0, 7, 200))
    ids, at = rng.integers(0, pseudolm.CLASSES, len(doc)), rng.permutation(len(doc))
    laid, place = pseudolm._laid(ids, doc)
    plain = [[ids[i + k] if 0 <= i + k < len(ids) and doc[i + k] == doc[i] else pseudolm.NONE for k in pseudolm.REACH] for i in at]
    assert pseudolm._around(laid, place[at]).tolist() == plain
    for scale in (1, 1e4):  # the second beyond what exponentials hold
        p = {k: v.astype(np.float64) * scale for k, v in pseudolm.initial().items()}
        context, target = rng.integers(0, pseudolm.CLASSES + 1, (300, 4)), rng.integers(0, pseudolm.CLASSES, 300)
        h = np.tanh(p["embed"][context].reshape(300, -1) @ p["w"] + p["b"])
        want, hi, low = np.zeros(300), target // pseudolm.DIGITS, target % pseudolm.DIGITS
        for state, at_, z in ((h, hi, "high"), (h + p["given"][hi], low, "low")):
            logits = state @ p[z] + p[z + "_b"]
            want += logits[np.arange(300), at_] - np.logaddexp.reduce(logits, axis=1)
        got = pseudolm.log_probability({k: v.astype(np.float32) for k, v in p.items()}, context, target)
        assert np.allclose(got, want, rtol=1e-3, atol=1e-3 * scale)


def test_words_find_their_class_faster_than_by_a_search():
    rng = np.random.default_rng(5)
    vocabulary = np.unique(rng.integers(0, 1 << 63, pseudolm.OWN).astype(np.uint64))
    hashes = rng.integers(0, 1 << 63, 400_000).astype(np.uint64)
    hashes[::2] = rng.choice(vocabulary, 200_000)

    def least(call):
        took = []
        for _ in range(7):
            began = time.process_time()
            call()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: pseudolm.classes_of(hashes, vocabulary, np.arange(len(vocabulary)))) < least(lambda: np.searchsorted(vocabulary, hashes))


def test_gradients_of_the_window_network():
    p = {k: v.astype(np.float64) for k, v in pseudolm.initial().items()}
    rng = np.random.default_rng(1)
    context, target = rng.integers(0, 40, (64, 4)), rng.integers(0, pseudolm.CLASSES, 64)
    for name, grad in pseudolm.Trainer(p).gradients(context, target).items():
        for at in rng.integers(0, grad.size, 3) if name != "embed" else (40 * k + 1 for k in range(3)):
            moved = []
            for step in (1e-5, -1e-5):
                q = {k: v.copy() for k, v in p.items()}
                q[name].reshape(-1)[at] += step
                moved.append(-pseudolm.log_probability(q, context, target).mean())
            assert math.isclose((moved[0] - moved[1]) / 2e-5, grad.reshape(-1)[at], rel_tol=1e-3, abs_tol=1e-8)


def test_pipeline_stages(spark):
    """Each stage on its own input, against the plain reading of what it decides."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "pack":
            assert out.schema.names == docs.schema.names
        folder = fresh_dir(spark, "t") + "/x"
        out.write.parquet(folder)
        out = spark.read.parquet(folder)
        before, after = now.toPandas(), out.toPandas()
        if name == "near_duplicates":
            want = {i for i, (_, c) in brute_components(list(zip(before.doc_id, before.text, strict=True)), 5, 80, 100).items() if c == i}
            assert set(after.doc_id) == want
        elif name == "mix":
            taken = mixing.mix_sources(now, corpus_pipeline.WEIGHTS).toPandas()
            assert Counter(after.doc_id) == {r.doc_id: math.ceil(r.taken / r.size) for r in taken.rename(columns={"size": "n"}).assign(size=taken["size"]).itertuples() if r.size and r.taken}
        elif name == "pack":
            assert after.length.sum() == sum(len(library_ids(x)) + 1 for x in before.text)
        now = out


def test_near_pairs_halve_and_lose_nothing():
    """Boxes only drop pairs beyond the limit: spread, dense and repeated rows, of one set and of two."""
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 0.12, (700, 8)), rng.normal(0.1, 0.01, (150, 8)), np.zeros((60, 8))])
    close = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2) <= 0.02
    every = np.arange(len(p))
    got = [x for i, j in vectors.near_pairs(p, every, None, 0.02) for x in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())]
    assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1)))))
    left, right = every[every % 3 == 0], every[every % 3 == 1]
    got = [tuple(sorted(x)) for i, j in vectors.near_pairs(p, left, right, 0.02) for x in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and len(got) == int(close[np.ix_(left, right)].sum())
    assert not list(vectors.near_pairs(p, every[:0], right, 0.02)) and not list(vectors.near_pairs(p, every[:1], None, 0.02))
