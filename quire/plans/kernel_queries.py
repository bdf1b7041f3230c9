"""Queries of the operators that run as kernels or folds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import geometry as g, jobs, kernels as k, pages, protect as p, running as r
from quire.plans import catalog


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _each(docs: DataFrame, f, kind: str) -> DataFrame:
    import pandas as pd

    return docs.select("doc_id", F.pandas_udf(lambda s: pd.Series([f(x) for x in s.fillna("")]), kind)("text").alias("out"))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document a page of its source's book, with a running header above it."""
    from pyspark.sql import Window

    docs = _docs(spark, sf_dir)
    at = docs.select("doc_id", F.col("source").alias("book"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("page_index"))
    header = F.concat((F.col("page_index") + 1).cast("string"), F.lit("   RUNNING "), F.coalesce("book", F.lit("")), F.lit("\n"))
    return docs.select("doc_id", "text").join(at, "doc_id").select("book", "page_index", F.concat(header, F.coalesce("text", F.lit(""))).alias("text"))


def pages_j5_merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, J5 in full: exact groups in the engine, greedy merging of each book's, then the threshold."""
    return pages.running_headers(_paged(spark, sf_dir))


def pages_c1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.clean_pages(_paged(spark, sf_dir))


def flow_c2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.repair_flow(_paged(spark, sf_dir))


def seg_a21_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.segment_flow(_docs(spark, sf_dir))


def md_k5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.markdown_html(_docs(spark, sf_dir))


def job_c17_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17 without an engine: C1, C2, P24, A19 or A21, K2."""
    return jobs.run_job(_paged(spark, sf_dir))


def job_k1_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3, K4 on the sentences of each document, with an engine that writes 3 for e; every fifth segment is restricted."""
    kind = F.when(F.col("seg_index") % 5 == 4, "restricted").when(F.col("seg_index") == 0, "title").otherwise("paragraph")
    segments = pages.segment_flow(_docs(spark, sf_dir), words=30).withColumn("type", kind)
    return jobs.assemble(jobs.translate_segments(segments, lambda texts, target: [x.replace("e", "3") for x in texts], "en"))


def ocr_s11_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 on documents cut to lines within words, after an eighth letter e, with a hyphen."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "((?:[^e]*e){8})([a-z])", "$1-\n$2"), "\n")
    return _docs(spark, sf_dir).select("doc_id", jobs.join_ocr_lines(lines).alias("text"))


def markers_a3_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _docs(spark, sf_dir).withColumn("text", F.concat_ws("\n", F.lit("1 of 3"), "text", F.lit("2 of 3")))
    return _each(marked, lambda x: k.strip_markers(x)[0], "string")


def flow_j8_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text"))
    return k.stitch_documents(lines.withColumn("text", F.regexp_replace("text", r"\.$", "")))


def para_a23_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_docs(spark, sf_dir), k.split_markdown, "string")


def seg_a20_word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(k.word_budget(sentences)).alias("seg_index", "text"))


def stream_r3_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"])
    return events.where("value is not null").groupBy("user_id").agg(k.ewma(ordered).alias("rate"))


def prot_c16_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    messages = talk.select(F.concat_ws("/", "conv_id", "turn").alias("msg_id"), F.concat(F.lit("{name} <b>"), "text", F.lit("</b>")).alias("text"))
    shout = lambda texts, _: [re.sub(r"(<[^<>]*>)|[^<]+", lambda m: m[1] or m[0].upper(), t) for t in texts]
    return p.protected_translate(messages, shout, "en")


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes: eight orders a page, twenty pages a document. Every third page is prose in two columns, the
    others hold a table; a page's last order is small print low on it, every seventh page is turned."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row, page = F.col("l_orderkey") % 8, F.floor(F.col("l_orderkey") / 8)
    prose, col = page % 3 == 0, F.col("l_linenumber").cast("double")
    words = F.concat(F.lit("Order of "), "l_returnflag", F.lit(" and "), "l_linestatus", F.lit(" runs on"))
    note, turned = (row == 7) & (page % 5 == 0), page % 7 == 3
    x0 = F.when(prose, (col - 1) % 2 * 300 + 20).otherwise(col * 80)
    y0 = F.when(note, F.lit(700.0)).when(prose, row * 60 + F.floor(col / 2) * 14.0).otherwise(row * 16.0)
    x1 = x0 + F.when(prose, 270).otherwise(30)
    text = F.when(prose | note, words).when(col == 1, words).otherwise(F.col("l_quantity").cast("string"))
    return lines.select(
        F.floor(page / 20).alias("doc_id"), (page % 20).alias("page_index"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frag_index"), text.alias("text"),
        *[F.when(turned, a).otherwise(b).cast("double").alias(n) for n, a, b in (("x0", y0, x0), ("y0", 700 - x1, y0), ("x1", y0 + 9, x1), ("y1", 700 - x0, y0 + 9))],
        F.when(note, 7.0).otherwise(10.0).alias("size"), turned.alias("rotated"),
    )


def geo_s6_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, A12-A17, P19-P22, F32, F33, W2."""
    return g.first_notes(g.analyse_layout(_fragments(spark, sf_dir)))


def geo_c9_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout or plain extraction, told from a sample of each document's pages."""
    probe = g.probe_pages(_fragments(spark, sf_dir))
    return g.layout_verdict(g.analyse_layout(probe), probe.groupBy("doc_id").agg(F.countDistinct("page_index").alias("n_pages")))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page number and a running header after each sentence."""
    header = lambda s, i: F.concat(s, F.lit(" "), (i + 1).cast("string"), F.lit(" THE OLD MILL ROAD"))
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=\.) "), header), " ")
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("book"), text.alias("text"))


def md_c5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 with A5, J6, J7, C3, J8 and C4."""
    return r.clean_books(_books(spark, sf_dir))


def md_c7_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    seen = F.pandas_udf(lambda s: pd.Series([list(r.preview(x)[1]) for x in s]), "array<string>")
    return _books(spark, sf_dir).select("book", seen("text").alias("headers"))


QUERIES = {f.__name__: f for f in (pages_j5_merged_headers, pages_c1_clean, flow_c2_repair, seg_a21_flow, md_k5_html, job_c17_extract, job_k1_translate, ocr_s11_join, markers_a3_strip, flow_j8_stitch, para_a23_split, seg_a20_word_budget, stream_r3_ewma, prot_c16_transform, geo_s6_regions, geo_c9_verdict, md_c5_clean, md_c7_preview)}



def _sentences_sql(held: str, cut: str, by: str) -> str:
    """Sentences (doc_id, i, x) of texts that are cut where ``cut`` matches."""
    return f"""with recursive s as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as place from (select doc_id, string_split(regexp_replace({held}, '{cut}', {by}, 'g'), chr(1)) as l from documents where text is not null) d),
w as (select doc_id, row_number() over (partition by doc_id order by place) as i, trim(replace(x, chr(57344), '.')) as x from s where trim(x) <> ''),
"""


def _grouped_sql(words: int) -> str:
    """Sentences in groups, the count starting afresh after each: one step of recursion a sentence."""
    count = r"len(regexp_extract_all({0}, '\S+'))".format
    return f"""r as (select doc_id, i, cast(0 as bigint) as seg, x, {count('x')} as total from w where i = 1
  union all select w.doc_id, w.i, r.seg + case when r.total >= {words} then 1 else 0 end, w.x, case when r.total >= {words} then 0 else r.total end + {count('w.x')} from r join w on w.doc_id = r.doc_id and w.i = r.i + 1)
"""


def _flow_sql(words: int) -> str:
    held = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    for x in pages.ABBREVIATIONS:
        held = f"replace({held}, '{x}', '{x.replace('.', chr(57344))}')"
    return _sentences_sql(held, r"""([.!?])\s+([A-Z0-9"‘“’''])""", r"'\1' || chr(1) || '\2'") + _grouped_sql(words)


_RESTRICTED = "case when contains(text, '⛔ RESTRICTED') then 'restricted' else 'paragraph' end"

#: SQL of its own for what SQL can say: a running mean by its closed form over each user's ordered values, sentences by
#: recursion, lines of Markdown by runs.
ORACLES = {
    "seg_a20_word_budget": _sentences_sql("text", r"([.!?])\s+", r"'\1' || chr(1)") + _grouped_sql(90) + "select doc_id, cast(seg as integer) as seg_index, string_agg(x, ' ' order by i) as text from r group by doc_id, seg",
    "seg_a21_flow": _flow_sql(pages.TARGET_WORDS) + f"select doc_id, seg as seg_index, {_RESTRICTED} as type, text from (select doc_id, seg, string_agg(x, ' ' order by i) as text from r group by doc_id, seg) g",
    "job_k1_translate": _flow_sql(30) + """, g as (select doc_id, seg, string_agg(x, ' ' order by i) as text from r group by doc_id, seg)
select doc_id, string_agg(case when seg % 5 = 4 then '> ' || text when seg = 0 then '# ' || replace(text, 'e', '3') else replace(text, 'e', '3') end || chr(10) || chr(10), '' order by seg) as markdown from g group by doc_id""",
    "md_k5_html": r"""with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as i, regexp_replace(unnest(string_split(text, chr(10))), '\s+$', '') as line from documents),
k as (select doc_id, i, line, case when line = '' then 'blank' when regexp_matches(line, '^#\s') then 'h1' when regexp_matches(line, '^##\s') then 'h2' when regexp_matches(line, '^-\s') then 'bullet' when line[1] = '>' then 'quote' else 'p' end as kind from l),
b as (select *, case kind when 'h1' then ltrim(line[2:]) when 'h2' then ltrim(line[3:]) when 'bullet' then ltrim(line[2:]) when 'quote' then case when line[2] = ' ' then line[3:] else line[2:] end else line end as raw,
  coalesce(lag(kind) over (partition by doc_id order by i), '') as before, coalesce(lead(kind) over (partition by doc_id order by i), '') as after from k),
e as (select *, replace(replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') as body from b where kind <> 'blank'),
h as (select doc_id, string_agg(case when kind = 'quote' and before <> 'quote' then '<blockquote>' || chr(10) else '' end
  || case when kind in ('h1', 'h2') then '<' || kind || '>' || body || '</' || kind || '>' when kind = 'bullet' then '<p class="bullet">• ' || body || '</p>' else '<p>' || body || '</p>' end
  || case when kind = 'quote' and after <> 'quote' then chr(10) || '</blockquote>' else '' end, chr(10) order by i) as html from e group by doc_id)
select d.doc_id, coalesce(h.html, '') as html from (select distinct doc_id from documents) d left join h on d.doc_id = h.doc_id""",
    "ocr_s11_join": """select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\r]*\n[ \t\r\n]*', ' ', 'g')) as text from documents""",
    "stream_r3_ewma": """with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events where value is not null)
select user_id, sum(case when i = 1 then value * power(0.7, n - 1) else 0.3 * value * power(0.7, n - i) end) as rate from e group by user_id""",
}
