"""Every relational operator against DuckDB, and the kernels against golden cases and laws."""

import os
import re

import duckdb
import pandas as pd
import pytest

from quire.operators import kernels as k
from quire.plans import catalog, kernel_queries
from quire.sources.files import decode

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for x in catalog.TABLES:
        con.sql(f"create view {x} as select * from '{SF}/{x}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    show = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)
    return sorted((tuple(show(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.OPERATORS))
def test_operator_matches_duckdb(spark, duck, name):
    got = rows(catalog.queries()[name](spark, SF).toPandas())
    assert got == rows(duck.sql(catalog.oracle_sql()[name]).df())


def merged(boxes):
    """Spans [lo, hi, n] of boxes that overlap or touch."""
    out = []
    for lo, hi in sorted(boxes):
        if out and lo <= out[-1][1]:
            out[-1][1:] = max(hi, out[-1][1]), out[-1][2] + 1
        else:
            out.append([lo, hi, 1])
    return out


def test_spans_and_gutters_are_of_all_boxes(spark):
    pages = {1: [(sub, sub * 10.0 + at, sub * 10.0 + at + 8) for sub in range(1, 8) for at in (0.0, 300.0)], 2: [(2, 0.0, 100.0), (4, 50.0, 160.0), (5, 160.0, 200.0), (7, 260.0, 300.0), (6, 270.0, 400.0)], 3: [(2, 0.0, 10.0)]}
    boxes = spark.createDataFrame([(page, sub, x0, x1) for page, b in pages.items() for sub, x0, x1 in b], "page bigint, sub bigint, x0 double, x1 double")
    got = catalog.run(spark, "geo_a9_merge_spans", {"v_fragment": boxes}).toPandas()
    for page, b in pages.items():
        assert got[got.page == page].sort_values("grp")[["lo", "hi", "n"]].values.tolist() == merged([x[1:] for x in b])
    cuts = catalog.run(spark, "geo_a10_gutter", {"v_fragment": boxes}).toPandas().set_index("page")
    assert cuts.loc[1].tolist() == [78.0, 310.0, 7] and cuts.loc[2].tolist() == [200.0, 260.0, 3] and len(cuts) == 2


def test_spans_of_the_table_are_of_all_boxes(duck):
    """The input view against plain Python, without the operator's text."""
    pages = {}
    for page, x0, x1 in duck.sql("select l_orderkey % 50, cast(l_linenumber * 90 + l_quantity as double), cast(l_linenumber * 90 + l_quantity + 20 + l_discount * 100 as double) from lineitem").fetchall():
        pages.setdefault(page, []).append((x0, x1))
    got = duck.sql(catalog.oracle_sql()["geo_a9_merge_spans"]).df()
    assert got.n.sum() == sum(map(len, pages.values())) and len(got) == sum(len(merged(b)) for b in pages.values())


def test_final_period_is_told_from_the_end_of_the_text(spark):
    texts = {1: "A text that is longer than twenty signs.", 3: "Short and open: this one has no stop", 2: "A text that is longer than twenty signs", 4: "Twenty signs and more, groß!", 5: "Sign twenty is a dot. And then", 6: "Sign twenty is a dot. And then", 8: "", 10: None}
    want = {1: texts[1], 3: texts[3], 2: texts[2], 4: "Twenty signs and more, gross!.", 5: texts[5], 6: texts[6], 8: ".", 10: "."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = catalog.run(spark, "prot_f26_f27_finish", {"documents": docs}).toPandas()
    assert dict(zip(got.doc_id, got.finished, strict=True)) == want


def test_f7_joins_whole_lines(spark):
    long = "this line is far longer than sixteen signs and ends in intelli-"
    texts = {1: f"{long} \n gent readers\nand a dash --\nlast of a paragraph-\nnext", 2: "one line only, well beyond sixteen signs", 3: "", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = catalog.run(spark, "flow_f7_join", {"documents": docs}).orderBy("doc_id", "line_index").toPandas()
    want = [long[:-1] + "gent readers", "gent readers and a dash --", "and a dash -- last of a paragraph-", "last of a paragraphnext", "next"]
    assert got[got.doc_id == 1].joined.tolist() == want
    assert got[got.doc_id == 2].joined.tolist() == [texts[2]] and len(got) == 6


def test_lru_keeps_20000_entries_and_evicts_the_least_recent(spark):
    many = spark.range(20_050).selectExpr("id as user_id", "cast(id % 1000 as timestamp) as ts")
    got = catalog.run(spark, "jobs_e8_lru", {"events": many}).toPandas()
    order = sorted(range(20_050), key=lambda i: (-(i % 1000), i))
    assert set(got.user_id) == set(order[:20_000]) and len(got) == 20_000
    few = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (1, 40), (4, 5)], "user_id bigint, ts bigint")
    assert sorted(catalog.run(spark, "jobs_e8_lru", {"events": few}, size=2).toPandas().user_id) == [1, 3]
    assert catalog.run(spark, "jobs_e8_lru", {"events": few}).count() == 4


def test_a19_splits_bullets_into_items(spark):
    blocks = {1: ["Before  the list", "ü first item", "goes on", "Ü  second\titem", "ü", "üü third"], 2: ["Über alles"], 3: ["a line", "b line"]}
    lines = spark.createDataFrame([(doc, i, x) for doc, b in blocks.items() for i, x in enumerate(b)], "doc_id bigint, line_index bigint, line string")
    got = catalog.run(spark, "seg_a19_classify", {"v_block": lines}).orderBy("doc_id", "first_line").toPandas()
    items = [(1, 0, "bullet", "Before the list"), (1, 1, "bullet", "first item goes on"), (1, 3, "bullet", "second item"), (1, 5, "bullet", "third")]
    assert list(got.itertuples(index=False, name=None)) == [*items, (2, 0, "heading", "Über alles"), (3, 0, "paragraph", "a line\nb line")]


@pytest.mark.parametrize("name", sorted(kernel_queries.ORACLES))
def test_kernel_query_matches_its_own_sql(spark, duck, name):
    got = rows(kernel_queries.QUERIES[name](spark, SF).toPandas())
    assert got and got == rows(duck.sql(kernel_queries.ORACLES[name]).df())


def test_headers_that_start_like_a_number_are_read_as_by_duckdb(spark):
    lines = [("b", i, 0, line) for i in range(3) for line in ("ción de xé", "iv Preface", "été 12", "Año xi")]
    lines = [(b, i, j, x) for j, (b, i, _, x) in enumerate(lines)]
    schema = "book string, page_index bigint, line_index bigint, line string"
    got = catalog.run(spark, "pages_a1_header_groups", {"v_line": spark.createDataFrame(lines, schema)}).toPandas()
    con = duckdb.connect()
    con.register("v_line", pd.DataFrame(lines, columns=["book", "page_index", "line_index", "line"]))
    assert "ón de xé" in set(got.header) and rows(got) == rows(con.sql(catalog.OPERATORS["pages_a1_header_groups"](catalog.DUCK)).df())


def test_sentences_keep_the_figures_at_their_ends(spark, duck, tmp_path):
    text = "0 is here. 1 and 1. 2 of 2! 3 or 33? 4.4.4 4"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = kernel_queries.QUERIES["seg_a20_word_budget"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(pd.DataFrame({"doc_id": [1], "seg_index": [0], "text": [text]}))


@pytest.mark.parametrize("name", sorted(set(kernel_queries.QUERIES) - set(kernel_queries.ORACLES)))
def test_kernel_queries_run(spark, name):
    assert kernel_queries.QUERIES[name](spark, SF).count() > 0


def test_markers():
    pages = "\f".join(f"Some text here.\n{i} of 103\nmore text" for i in range(1, 5))
    clean, gone = k.strip_markers(pages)
    assert gone == {"N of 103": 4} and clean.count("\f") == 3 and "of 103" not in clean
    for kept in ("We saw 3 of 10 patients again.", "dated 12/05/1920 and 3/4 cup", "See page 12 of it", "5 of 3\n6 of 3"):
        assert k.strip_markers(kept) == (kept, {})
    rising = " ".join(f"word {i} of 250 word" for i in range(1, 7))
    assert k.strip_markers(rising)[1] == {"N of 250": 6}


def test_similar_headers_merge_to_the_most_frequent():
    got = k.merge_similar([("preface", 5), ("prefaee", 1), ("foreword", 4)])
    assert got == {"preface": "preface", "prefaee": "preface", "foreword": "foreword"}


def test_stitch():
    start = "The theory was first put forward by a group of writers in the old town and then"
    blocks = [start, "Table 1", "12 13 14 15", "taken up by others.", "A new one."]
    kept, n = k.stitch(blocks)
    assert n == 1 and kept[0][1].endswith("and then taken up by others.") and len(kept) == 4
    assert k.stitch(["A highly intelli-", "gent reader."])[0] == [(0, "A highly intelligent reader.")]
    assert k.stitch([start, "A barrier sentence ends here.", "taken up"])[1] == 0


def test_paragraphs_keep_words_and_lines():
    text = " ".join(f"This is sentence number {i} of a rather long paragraph about nothing." for i in range(30))
    parts = k.split_paragraph(text)
    assert " ".join(parts).split() == text.split() and all(k.count_lines(p) <= 6 for p in parts)
    md = f"# Title\n\n{text}\n\n- item"
    once = k.split_markdown(md)
    assert k.split_markdown(once) == once and once.startswith("# Title") and once.endswith("- item")


MESSAGES = ["", "Hello {name}", "{n, plural, one {# cat} other {# cats <b>{x}</b>}}", "{g, select, f {She} other {They}} said", "a <b>c</b> <br/>", "it''s '{quoted}'", "{n, plural, offset:1 =0 {none} other {many}}"]


@pytest.mark.parametrize("m", MESSAGES)
def test_messages_round_trip(m):
    assert k.render_message(k.parse_message(m)) == m
    masked, found = k.mask(m, ["cat"])
    assert k.unmask(masked, found) == m


@pytest.mark.parametrize("m", ["{", "<b>x", "x</b>", "{n, plural}", "{n, plural, one {x}}"])
def test_bad_messages(m):
    with pytest.raises(k.MessageError):
        k.parse_message(m)


def test_decode():
    assert decode("é".encode()) == "é" and decode(b"\xe9") == "é" and decode(b"\x81") == "\x81"


def test_no_operator_is_named_twice():
    assert all(re.fullmatch(r"[a-z]+_[a-z0-9_]+", n) for n in catalog.OPERATORS)
