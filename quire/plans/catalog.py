"""Relational operators of document cleaning, each one declarative text that Catalyst plans.

A text names its inputs as views; ``run`` binds them to DataFrames. Groups are always a book or a document;
filters stand below joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.functions import text as t
from quire.functions.dialect import DUCK, SPARK, Spark
from quire.sources.inputs import NEEDS, VIEWS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
OPERATORS: dict[str, Callable[..., str]] = {}


def operator(f):
    OPERATORS[f.__name__] = f
    return f


def _with(d: Spark, body: str) -> str:
    used: list[str] = []

    def need(sql: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", sql) and v not in used:
                need(VIEWS[v](d))
                used.append(v)

    need(body)
    parts = ", ".join(f"{v} as ({VIEWS[v](d)})" for v in used)
    if not parts:
        return body
    if m := re.match(r"\s*with\s+(recursive\s+)?", body):
        return f"with {m[1] or ''}{parts}, {body[m.end():]}"
    return f"with {parts} {body}"


def sql(name: str, d: Spark = DUCK) -> str:
    return _with(d, OPERATORS[name](d))


def run(spark: SparkSession, name: str, frames: dict[str, DataFrame], **options: int) -> DataFrame:
    """Apply an operator to DataFrames: its input views by name, or the tables they derive from; ``options`` are its own."""
    body = OPERATORS[name](SPARK, **options)
    body = body if any(re.search(rf"\b{v}\b", body) for v in frames if v in VIEWS) else _with(SPARK, body)
    bound = {k: v for k, v in frames.items() if re.search(rf"\b{k}\b", body)}
    for k in bound:
        body = re.sub(rf"\b(from|join)\s+{k}\b", rf"\1 {{{k}}}", body)
    plain = re.sub(r"\{(?!(?:" + "|".join(map(re.escape, bound)) + r")\})", "{{", body) if bound else body
    plain = re.sub(r"(?<!\w)\}|(?<=\w)\}", lambda m: "}" if any(plain[: m.start()].endswith("{" + k) for k in bound) else "}}", plain)
    return spark.sql(plain, **bound)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(name: str):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            text = sql(name, SPARK)
            return run(spark, name, {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in TABLES if re.search(rf"\b{x}\b", text)})

        return query

    return {name: make(name) for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: sql(name, DUCK) for name in OPERATORS}


_EDGE = """edge as (
  select book, page_index, line_index, line from (
    select *, row_number() over (partition by book, page_index order by line_index) as a, row_number() over (partition by book, page_index order by line_index desc) as z
    from v_line where {filled}) e where a <= 3 or z <= 3)"""


def _edge(d):
    return _EDGE.format(filled=f"{t.strip(d, 'line')} <> ''")


@operator
def pages_e1_edge_lines(d):
    return f"with {_edge(d)} select book, page_index, line_index, line from edge where {t.candidate_shape(d, 'line')}"


@operator
def pages_a1_header_groups(d):
    core = f"lower({t.strip_number(d, 'line', d.word_start, d.word_end)})"
    words = ", ".join(d.lit(w) for w in t.CHAPTER_WORDS)
    return f"""with {_edge(d)},
keyed as (select book, page_index, line_index, line, {t.is_number_line(d, t.strip(d, 'line'))} as bare, {core} as core from edge where {t.candidate_shape(d, 'line')}),
grouped as (select book, case when bare then '#' else core end as header, cast(count(*) as bigint) as n, cast(count(distinct page_index) as bigint) as n_pages, min(page_index * 10000000 + line_index) as first_at
  from keyed group by book, case when bare then '#' else core end)
select book, header, n, n_pages, first_at from grouped where (n >= 3 or header = '#') and upper({d.replace('header', '[ .:—–-]', '')}) not in ({words})"""


_REPEATED = """banned as (
  select l.book, l.key, l.n_on from (
    select book, key, cast(count(distinct page_index) as bigint) as n_on, max(n_pages) as n_pages from keyed where key <> '' group by book, key) l
  where l.n_pages >= 4 and l.n_on >= greatest(4, cast(floor(0.6 * l.n_pages) as bigint)))"""


def _keyed(d):
    return f"keyed as (select book, page_index, n_pages, line_index, line, {t.normalise(d, 'line')} as key from v_line)"


@operator
def pages_a2_repeated_lines(d):
    return f"with {_keyed(d)}, {_REPEATED} select book, key, n_on from banned"


@operator
def pages_e3_top_patterns(d):
    return f"with {_keyed(d)}, {_REPEATED} select book, key, rank_in_book from (select book, key, cast(row_number() over (partition by book order by key) as bigint) as rank_in_book from banned) r where rank_in_book <= 4"


@operator
def pages_j2_strip_lines(d):
    return f"""with {_keyed(d)}, {_REPEATED}
select k.book, k.page_index, k.line_index, k.line from keyed k left join banned b on k.book = b.book and k.key = b.key where b.key is null"""


@operator
def pages_j4_keep_groups(d):
    return f"""with {_keyed(d)}, {_REPEATED}, ranked as (select book, key, n_on, row_number() over (partition by book order by n_on desc, key) as g from banned)
select book, key, n_on from ranked where not (g = 1 and book like '%1%')"""


@operator
def markers_a3_detect(d):
    return rf"""with found as (
  select book, page_index, line_index, try_cast({d.extract('line', '^ *([0-9]+) of ([0-9]+) *$', 1)} as bigint) as num, try_cast({d.extract('line', '^ *([0-9]+) of ([0-9]+) *$', 2)} as bigint) as total
  from v_line where {d.like('line', '^ *[0-9]{1,4} of [0-9]{1,4} *$')}),
stepped as (select *, lag(num) over (partition by book, total order by page_index, line_index) as before from found where num <= total)
select book, total, cast(count(*) as bigint) as n, cast(count(distinct num) as bigint) as n_distinct,
  coalesce(avg(case when before is null then null when num > before then 1.0e0 else 0.0e0 end), 0.0e0) as increasing
from stepped group by book, total having count(distinct num) >= 2"""


@operator
def markers_f37_label(d):
    return f"select doc_id, {d.replace(chr(39) + 'N of M' + chr(39), r'\bM\b', '103')} as label from documents"


@operator
def seg_p24_strategy(d):
    return f"""select doc_id, cast(sum(case when {t.strip(d, 'line')} = '' then 1 else 0 end) as bigint) as blank, cast(sum(case when {t.strip(d, 'line')} <> '' then 1 else 0 end) as bigint) as filled,
  case when sum(case when {t.strip(d, 'line')} = '' then 1 else 0 end) >= 20 and sum(case when {t.strip(d, 'line')} = '' then 1 else 0 end) >= 0.05 * sum(case when {t.strip(d, 'line')} <> '' then 1 else 0 end) then 'blocks' else 'flow' end as strategy
from v_block group by doc_id"""


def _blocks(d):
    return f"""kept as (select doc_id, line_index, {t.strip(d, 'line')} as line from v_block where not {d.like(t.strip(d, 'line'), '^[0-9]+$')}),
numbered as (select *, sum(case when line = '' then 1 else 0 end) over (partition by doc_id order by line_index rows between unbounded preceding and current row) as run from kept),
blocks as (select doc_id, run, cast(count(*) as bigint) as n_lines, min(line_index) as first_line, {d.joined('line', d.newline(), 'line_index')} as text from numbered where line <> '' group by doc_id, run)"""


@operator
def seg_a18_blocks(d):
    return f"with {_blocks(d)} select doc_id, cast(row_number() over (partition by doc_id order by run) - 1 as bigint) as block_index, n_lines, text from blocks"


@operator
def seg_a19_classify(d):
    """Blocks with their type; one with a line that starts with ü has a row for each of its items."""
    sign = d.like("line", "^[üÜ]")
    item = d.replace(d.joined("line", "' '", "line_index"), r"[ \t\n\r\f]+", " ")
    return f"""with {_blocks(d)},
typed as (select doc_id, run, first_line, case when {d.like('text', '(?m)^ü')} then 'bullet' when text like '⛔ RESTRICTED%' then 'restricted' when n_lines = 1 and length(text) <= 100 then 'heading' else 'paragraph' end as type, text from blocks),
signs as (select n.doc_id, n.run, n.line_index, n.line, sum(case when {sign} then 1 else 0 end) over (partition by n.doc_id, n.run order by n.line_index rows between unbounded preceding and current row) as item
  from numbered n join typed b on n.doc_id = b.doc_id and n.run = b.run where b.type = 'bullet' and n.line <> ''),
bare as (select doc_id, run, line_index, item, {t.strip(d, d.replace('line', '^[üÜ]+', ''))} as line from signs),
items as (select doc_id, min(line_index) as first_line, {item} as text from bare group by doc_id, run, item)
select doc_id, first_line, type, text from typed where type <> 'bullet'
union all select doc_id, first_line, 'bullet', {t.strip(d, 'text')} from items where {t.strip(d, 'text')} <> ''"""


@operator
def seg_f13_abbreviations(d):
    words = ["Mr.", "Mrs.", "Ms.", "Dr.", "St.", "Jr.", "Sr.", "vs.", "etc.", "Prof.", "Rev.", "Gen.", "Col.", "Capt.", "Lt.", "Sgt.", "No.", "Vol.", "pp.", "U.S.", "U.K.", "i.e.", "e.g.", "A.D.", "B.C.", "Ph.D.", "Ave."]  # fixed values
    x = "concat('Dr. ', coalesce(text, ''), ' etc. e.g. this')"
    for w in words:
        x = f"replace({x}, {d.lit(w)}, {d.lit(w.replace('.', chr(0xE000)))})"
    return f"select doc_id, cast(length({x}) - length(replace({x}, {d.lit(chr(0xE000))}, '')) as bigint) as protected from documents"


@operator
def flow_p4_p8_flags(d):
    return f"select doc_id, line_index, {t.is_note(d, 'line')} as note, {t.is_unfinished(d, 'line')} as unfinished, {t.is_continuation(d, 'line')} as continuation, {t.is_skippable(d, 'line')} as skippable from v_block"


@operator
def flow_j8_one_hop(d):
    return f"""with cut as (select doc_id, line_index, case when line_index % 4 = 0 then {d.replace('line', '[.]$', '')} else lower(line) end as line from v_block),
flagged as (select doc_id, line_index, line, {t.is_unfinished(d, 'line')} as unfinished, {t.is_continuation(d, 'line')} as continuation, {t.is_skippable(d, 'line')} as skippable from cut),
paired as (select doc_id, line_index, line, unfinished,
  min(case when not skippable or continuation then line_index end) over (partition by doc_id order by line_index rows between 1 following and 60 following) as next_index from flagged)
select p.doc_id, p.line_index, p.next_index, {t.join_hyphen(d, 'p.line', 'n.line')} as joined from paired p join flagged n on p.doc_id = n.doc_id and p.next_index = n.line_index where p.unfinished and n.continuation"""


@operator
def flow_f7_join(d):
    """Every line with the next one that is not blank; a document's last line stands alone."""
    return f"""with filled as (select doc_id, line_index, {t.strip(d, 'line')} as line from v_block where {t.strip(d, 'line')} <> ''),
paired as (select *, lead(line) over (partition by doc_id order by line_index) as after from filled)
select doc_id, line_index, case when after is null then line else {t.join_hyphen(d, 'line', 'after')} end as joined from paired"""


@operator
def post_p9_demote(d):
    return f"select doc_id, line_index, {t.should_demote(d, 'line')} as demote from v_block"


@operator
def post_j1_aligned_demote(d):
    return f"""with {_blocks(d)}, src as (select doc_id, run, text, case when n_lines = 1 and length(text) <= 100 then 'heading' else 'paragraph' end as type from blocks),
outp as (select doc_id, run, text from blocks where not (doc_id % 4 = 0 and run = 0)),
sizes as (select s.doc_id, s.n = o.n as aligned from (select doc_id, count(*) as n from src group by doc_id) s join (select doc_id, count(*) as n from outp group by doc_id) o on s.doc_id = o.doc_id)
select s.doc_id, cast(s.run as bigint) as block, z.aligned, case when z.aligned and s.type = 'heading' and {t.should_demote(d, 's.text')} then 'paragraph' else s.type end as type, {t.close_hyphens(d, 'o.text')} as text
from src s join outp o on s.doc_id = o.doc_id and s.run = o.run join sizes z on s.doc_id = z.doc_id"""


@operator
def post_f9_hyphens(d):
    x = d.replace("text", "([a-z]) ([a-z])", "$1- $2")
    return f"select doc_id, {d.count(x, t.HYPHEN_GAP)} as fixes, {t.close_hyphens(d, x)} as fixed from documents"


@operator
def text_f1_normalise(d):
    return f"select doc_id, {t.normalise(d, 'text')} as norm, {t.upper_words(d, 'text')} as words, {t.letters(d, 'text')} as letters from documents"


@operator
def text_f6_edge_words(d):
    return f"select doc_id, {d.extract('text', r'^(\p{L}+)', 1)} as first_word, {d.extract('text', r'(\p{L}+)$', 1)} as last_word from documents"


@operator
def text_f22_edges(d):
    return f"select doc_id, {d.extract('text', r'^[^\p{L}\p{N}]*')} as lead, {d.extract('text', r'[^\p{L}\p{N}]*$')} as trail, {d.like('text', r'\p{L}')} as has_letters from documents"


@operator
def text_f24_spaces(d):
    x = "concat('a', {0}, 'b', {1}, 'c', coalesce(text, ''))".format(d.lit(chr(0xA0)), d.lit(chr(0xAD)))
    return f"select doc_id, replace(translate({x}, {d.lit(chr(0xA0) + chr(0x202F) + chr(0x2009) + chr(0x2011))}, '   -'), {d.lit(chr(0xAD))}, '') as plain from documents"


@operator
def prot_f25_typography(d):
    x = "concat('« ', coalesce(text, ''), ' » ! „x“ ?')"
    return f"select doc_id, lang, {t.typography(d, x, 'lang')} as shown from documents"


@operator
def prot_f26_f27_finish(d):
    out = t.swiss(d, "concat(coalesce(text, ''), case when doc_id % 2 = 0 then '.' else '' end)")
    return f"select doc_id, {t.final_period(d, out, "coalesce(text, '')")} as finished from documents"


def _marks(d, x):
    marks = r"\{[a-z]+\}|</?[a-z]>"
    if d.name == "spark":
        return f"select msg_id, mark, cast(count(*) as bigint) as n from (select msg_id, explode(regexp_extract_all({x}, {d.lit('(' + marks + ')')}, 1)) as mark from v_message) e group by msg_id, mark"
    return f"select msg_id, mark, cast(count(*) as bigint) as n from (select msg_id, unnest(regexp_extract_all({x}, {d.lit(marks)})) as mark from v_message) e group by msg_id, mark"


def _diff(d):
    return f"""a as ({_marks(d, 'source_text')}), b as ({_marks(d, 'output_text')}),
diff as (select coalesce(a.msg_id, b.msg_id) as msg_id, coalesce(a.mark, b.mark) as mark, coalesce(a.n, 0) as expected, coalesce(b.n, 0) as got from a full outer join b on a.msg_id = b.msg_id and a.mark = b.mark)"""


@operator
def prot_a26_marker_diff(d):
    return f"with {_diff(d)} select msg_id, mark, cast(greatest(expected - got, 0) as bigint) as missing, cast(greatest(got - expected, 0) as bigint) as extra from diff where expected <> got"


@operator
def prot_p30_defect_class(d):
    return f"""with {_diff(d)}, s as (select msg_id, sum(case when mark like '<%' and expected > got then 1 else 0 end) as tags, sum(case when mark like '{{%' and expected > got then 1 else 0 end) as holders, sum(case when got > expected then 1 else 0 end) as extra from diff group by msg_id)
select msg_id, case when extra > 0 then 'extra' when tags > 0 and holders > 0 then 'mixed' when tags > 0 then 'lost pair' when holders > 0 then 'lost placeholder' else 'intact' end as defect from s"""


@operator
def geo_a6_clusters(d):
    return """with stepped as (select page, frag, sub, y0, case when y0 - lag(y0) over (partition by page order by y0, frag, sub) > 6.0 then 1 else 0 end as new from v_fragment),
numbered as (select *, cast(sum(new) over (partition by page order by y0, frag, sub rows between unbounded preceding and current row) as bigint) as grp from stepped)
select page, grp, cast(count(*) as bigint) as n, cast(median(y0) as double) as centre from numbered group by page, grp"""


@operator
def geo_j9_nearest(d):
    return """with stepped as (select page, frag, sub, x0, case when x0 - lag(x0) over (partition by page order by x0, frag, sub) > 14.0 then 1 else 0 end as new from v_fragment),
numbered as (select *, sum(new) over (partition by page order by x0, frag, sub rows between unbounded preceding and current row) as grp from stepped),
centres as (select page, grp, cast(median(x0) as double) as centre from numbered group by page, grp),
near as (select f.page, f.frag, f.sub, c.grp, row_number() over (partition by f.page, f.frag, f.sub order by abs(f.x0 - c.centre), c.grp) as r from v_fragment f join centres c on f.page = c.page)
select page, frag, sub, cast(grp as bigint) as grp from near where r = 1"""


_SPANS = """reach as (select page, x0, x1, max(x1) over (partition by page order by x0, x1 rows between unbounded preceding and 1 preceding) as before from v_fragment),
marked as (select *, sum(case when before is null or x0 > before then 1 else 0 end) over (partition by page order by x0, x1 rows between unbounded preceding and current row) as grp from reach),
spans as (select page, cast(grp as bigint) as grp, min(x0) as lo, max(x1) as hi, cast(count(*) as bigint) as n from marked group by page, grp)"""


@operator
def geo_a9_merge_spans(d):
    return f"with {_SPANS} select page, grp, lo, hi, n from spans"


@operator
def geo_a10_gutter(d):
    return f"""with {_SPANS}, gaps as (select page, hi as cut_from, lead(lo) over (partition by page order by lo) as cut_to, sum(n) over (partition by page order by lo rows between unbounded preceding and current row) as n_left, sum(n) over (partition by page) as n_all from spans),
best as (select *, row_number() over (partition by page order by cut_to - cut_from desc, cut_from) as r from gaps where cut_to is not null and n_all >= 4 and cut_to - cut_from > 0.022 * 595 and n_left between 0.15 * n_all and 0.85 * n_all)
select page, cut_from, cut_to, cast(n_left as bigint) as n_left from best where r = 1"""


@operator
def geo_a27_body_size(d):
    return "select page, cast(median(size) as double) as body_size from v_fragment where not rotated and size > 0 group by page"


@operator
def geo_s7_probe_pages(d):
    step = f"greatest(1, {d.div('n_pages - s', '24')})"
    return f"""with p as (select book, page_index, n_pages, case when n_pages > 2 then 1 else 0 end as s from v_book),
q as (select book, page_index, row_number() over (partition by book order by page_index) as r from p where page_index >= s and (page_index - s) % {step} = 0)
select book, page_index from q where r <= 24"""


@operator
def geo_f34_numeric_share(d):
    return f"select doc_id, avg(case when length(line) > 0 and length({d.replace('line', '[^0-9]', '')}) >= 0.30 * length(line) then 1.0e0 else 0.0e0 end) as share from v_block group by doc_id"


@operator
def geo_p23_layout_useful(d):
    return """select page, cast(count(*) as bigint) as n, cast(sum(case when sub > 2 then 1 else 0 end) as bigint) as multi, count(*) >= 3 and (sum(case when sub > 2 then 1 else 0 end) >= 0.4 * count(*) or sum(case when rotated then 1 else 0 end) >= 0.2 * count(*)) as useful from v_fragment group by page"""


@operator
def geo_w2_first_notes(d):
    key = d.replace(t.normalise(d, "line"), "[0-9]+", "#")
    return f"""with k as (select doc_id, line_index, {key} as key from v_block where {t.strip(d, 'line')} <> ''), r as (select *, row_number() over (partition by doc_id, key order by line_index) as r, count(*) over (partition by doc_id, key) as n from k)
select doc_id, line_index, cast(n - 1 as bigint) as dropped from r where r = 1"""


@operator
def geo_e6_reading_order(d):
    return "select page, frag, sub, cast(row_number() over (partition by page order by y0, x0, frag, sub) as bigint) as place from v_fragment"


@operator
def geo_u1_deferred(d):
    """Ten pages are a document; its tables and notes stand behind all of its body text."""
    return f"""select page, sub as kind, cast(row_number() over (partition by {d.div('page', '10')} order by case when sub <= 3 then 0 when sub <= 5 then 1 else 2 end, page, sub) as bigint) as place from (select distinct page, sub from v_fragment) x"""


@operator
def render_k3_markdown(d):
    kind = "case doc_id % 5 when 0 then 'title' when 1 then 'heading' when 2 then 'bullet' when 3 then 'restricted' else 'paragraph' end"
    return f"select doc_id, {t.render(d, kind, 'text')} as markdown from documents where text is not null"


@operator
def render_k4_assemble(d):
    return f"with {_blocks(d)} select doc_id, {d.joined(t.render(d, chr(39) + 'paragraph' + chr(39), 'text'), d.newline(), 'run')} as markdown from blocks group by doc_id"


@operator
def render_w4_quote_runs(d):
    return """with q as (select doc_id, line_index, line, line_index % 7 < 3 as quoted from v_block),
s as (select *, case when quoted and not coalesce(lag(quoted) over (partition by doc_id order by line_index), false) then 1 else 0 end as new from q),
n as (select *, sum(new) over (partition by doc_id order by line_index rows between unbounded preceding and current row) as run from s)
select doc_id, cast(run as bigint) as run, min(line_index) as first_line, cast(count(*) as bigint) as n from n where quoted group by doc_id, run"""


@operator
def render_k7_first_title(d):
    return f"select page_id, nullif({d.extract('html', '<h1>([^<]*)</h1>', 1)}, '') as title from pages"


@operator
def jobs_p27_resumable(d):
    return "select job, not finished and done_share > 0 and hash_now = hash_then as resumable from v_state"


@operator
def jobs_k11_pointer(d):
    return "select s.job, coalesce(p.job, s.job) as real_job from v_state s left join v_state p on p.job = s.job + 1 and p.hash_then = s.hash_now"


@operator
def jobs_k17_latest(d):
    return "select owner, job, total from (select *, row_number() over (partition by owner order by started desc, job desc) as r from v_state) x where r = 1"


@operator
def jobs_k12_first_version(d):
    return "select owner, job from (select *, row_number() over (partition by owner order by started, job) as r from v_state) x where r = 1"


@operator
def jobs_k13_unique_names(d):
    n = f"cast({t.file_name(d, 'o_orderpriority')} as varchar(200))"
    return f"select o_orderkey, case when r = 1 then concat(name, '.md') else concat(name, ' (', cast(r as varchar(20)), ').md') end as file from (select o_orderkey, {n} as name, row_number() over (partition by o_orderpriority order by o_orderkey) as r from orders) x"


@operator
def jobs_e8_lru(d, size: int = 20_000):
    return f"select user_id, max(ts) as last_used from events group by user_id order by max(ts) desc, user_id limit {size}"


@operator
def jobs_e5_first_segments(d):
    return "select doc_id, line_index from v_block where line_index < 10"


@operator
def jobs_e7_length_batches(d):
    """A request's texts by length, in batches of eight; a request is a conversation, so no window spans the table."""
    return f"select conv_id, turn, cast({d.div('row_number() over (partition by conv_id order by length(text), turn, role, text) - 1', '8')} as bigint) as batch from conversations where text is not null"


@operator
def jobs_a29_usage(d):
    return "select role, cast(count(*) as bigint) as requests, cast(sum(length(text)) as bigint) as characters from conversations group by role"


@operator
def jobs_f40_percent(d):
    return "select job, case when total = 0 then 0.0e0 else 100.0e0 * done_share / total end as percent from v_state"


@operator
def jobs_f41_duration(d):
    return f"select job, {t.duration(d, 'total * 37')} as shown from v_state"


@operator
def jobs_a28_totals(d):
    return "select owner, cast(sum(case when finished then 1 else 0 end) as bigint) as finished, cast(sum(case when hash_now <> hash_then then 1 else 0 end) as bigint) as changed from v_state group by owner"


@operator
def files_s1_formats(d):
    x = "lower(concat(url, case page_id % 4 when 0 then '.PDF' when 1 then '.epub' when 2 then '.html' else '.md' end))"
    return f"select page_id, {d.extract(x, r'(\.[^./]*)$', 1)} in ('.pdf', '.epub', '.txt', '.md', '.markdown') as supported from pages"


@operator
def files_f10_names(d):
    return f"select page_id, {t.file_name(d, 'url')} as file, {t.title_words(d, 'url')} as title from pages"


@operator
def files_f38_hash(d):
    return "select doc_id, " + ("sha2(text, 256)" if d.name == "spark" else "sha256(text)") + " as hash from documents"


@operator
def ocr_s9_flagged(d):
    return "select user_id, cast(count(value) as bigint) as n, count(value) = 0 or min(value) < 0.75 as flagged from events group by user_id"


@operator
def ocr_s10_parse(d):
    x = "concat('PAGE_NUMBER: ', cast(doc_id as varchar(20)), {0}, 'HEADER: ', case when doc_id % 2 = 0 then 'none' else source end, {0}, '---', {0}, coalesce(text, ''), case when doc_id % 3 = 0 then '<uncertain>x</uncertain>' else '' end)".format(d.newline())
    return f"""select doc_id, nullif({d.extract(x, '(?m)^PAGE_NUMBER: *(.*)$', 1)}, 'none') as printed, nullif({d.extract(x, '(?m)^HEADER: *(.*)$', 1)}, 'none') as header,
  {d.like(x, '<uncertain>')} as flagged, {t.strip(d, d.replace(d.extract(x, '(?s)---(.*)', 1), '</?uncertain>', ''))} as body from documents"""


@operator
def ocr_p25_changed(d):
    return f"select doc_id, {t.normalise(d, 'text')} <> {t.normalise(d, 'replace(text, ' + chr(39) + 'the ' + chr(39) + ', ' + chr(39) + 'the  ' + chr(39) + ')')} as changed from documents"


@operator
def gloss_s14_entries(d):
    return "select c_nationkey as glossary, c_name as source, c_mktsegment as target from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey desc) as r from customer) x where r = 1 and trim(c_name) <> '' and trim(c_mktsegment) <> ''"


@operator
def gloss_u5_merge(d):
    return "select coalesce(b.n_nationkey, a.n_nationkey) as k, coalesce(b.n_name, a.n_name) as v from nation a full outer join (select n_nationkey, lower(n_name) as n_name from nation where n_nationkey % 2 = 0) b on a.n_nationkey = b.n_nationkey"


@operator
def gloss_j14_missing(d):
    return "select distinct a.p_name from part a left join (select distinct p_name from part where p_partkey % 40 = 0) c on a.p_name = c.p_name where c.p_name is null"


@operator
def lang_f43_lookup(d):
    rows = "values ('en', 'English', 'eng'), ('fr', 'French', 'fra'), ('de', 'German', 'deu')"
    return f"select doc_id, coalesce(l.label, d.lang) as label, l.iso3 from documents d left join ({rows}) as l(code, label, iso3) on d.lang = l.code"


@operator
def stream_r3_pairs(d):
    return f"select user_id, event_id, {d.stamp('ts')} - lag({d.stamp('ts')}) over (partition by user_id order by ts, event_id) as gap_us from events"


@operator
def stream_r4_stalls(d):
    return f"""with g as (select user_id, event_id, ({d.stamp('ts')} - lag({d.stamp('ts')}) over (partition by user_id order by ts, event_id)) / 1000000.0e0 as gap from events)
select user_id, case when gap < 60 then 'active' when gap < 900 then 'slow' else 'stalled' end as verdict, cast(count(*) as bigint) as n from g where gap is not null group by user_id, case when gap < 60 then 'active' when gap < 900 then 'slow' else 'stalled' end"""


@operator
def lang_f44_pair_models(d):
    rows = "(values ('en', 'en'), ('fr', 'fr'), ('de', 'de')) as {0}(code, iso2)"
    return f"""select doc_id, 'pair-' || a.iso2 || '-' || b.iso2 as model from (select doc_id, lang, case doc_id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'zz' end as target from documents) x
left join {rows.format('a')} on x.lang = a.code left join {rows.format('b')} on x.target = b.code"""


@operator
def ocr_f39_cost(d):
    """Tokens at a model's rates; an unknown model has the default ones."""
    return """select l_orderkey, l_linenumber, l_quantity * 1000 / 1000000.0e0 * coalesce(r.rate_in, 3.0e0) + l_extendedprice / 1000000.0e0 * coalesce(r.rate_out, 15.0e0) as usd
from lineitem left join (values ('A', 1.0e0, 5.0e0), ('N', 2.0e0, 10.0e0)) as r(model, rate_in, rate_out) on l_returnflag = r.model"""


@operator
def ocr_s13_last_page_line(d):
    return "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) x where r = 1"


@operator
def ocr_f36_restricted_page(d):
    page = "concat('page ', coalesce(case when page_index % 3 = 0 then cast(page_index * 2 as varchar(20)) end, cast(page_index + 1 as varchar(20))))"
    return f"select doc_id, concat('[[ ', {page}, {d.newline()}, {t.strip(d, d.replace('text', '[ ' + chr(92) + 't' + chr(92) + 'n]+', ' '))}, {d.newline()}, ']] ', {page}) as block from v_book where text is not null"


@operator
def gloss_s16_terms(d):
    x = "concat(p_name, ', ', p_brand, ',,', p_type)"
    if d.name == "spark":
        own = f"select p_partkey, i, term from part lateral view posexplode(split({x}, '[\\n,]')) as i, term"
    else:
        own = f"select p_partkey, generate_subscripts(l, 1) - 1 as i, unnest(l) as term from (select p_partkey, regexp_split_to_array({x}, '[\n,]') as l from part) y"
    return f"with e as ({own}) select p_partkey, cast(row_number() over (partition by p_partkey order by i) as bigint) as place, trim(term) as term from e where trim(term) <> ''"


@operator
def gloss_j16_compatible(d):
    return """select c.c_custkey, case when g.n_nationkey is null then 'unknown' when g.n_regionkey <> c.want then 'wrong target' else 'ok' end as verdict
from (select c_custkey, c_nationkey + c_custkey % 2 * 3 as glossary, c_nationkey % 5 as want from customer) c left join nation g on g.n_nationkey = c.glossary"""


@operator
def gloss_j13_first_term(d):
    """The leftmost listed term, the longest where several start."""
    return f"select doc_id, nullif({d.extract('lower(text)', '(the old|the|and)', 1)}, '') as term from documents where text is not null"


@operator
def prot_p31_stray_markup(d):
    bare = d.replace("output_text", r"\{[a-z]+\}|</?b>", " ")
    return f"select msg_id, {d.like(bare, '[{}<>]')} as stray from v_message"


@operator
def prot_u3_term_losses(d):
    n = lambda x: d.count(x, r"\{count\}")
    return f"select msg_id, {n('source_text')} - {n('output_text')} as lost from v_message where {n('source_text')} <> {n('output_text')}"


@operator
def jobs_s17_limits(d):
    return "select conv_id, cast(count(*) as bigint) as n, count(*) <= 50 and sum(length(coalesce(text, ''))) <= 2097152 as accepted from conversations group by conv_id"


@operator
def jobs_k18_abandoned(d):
    """Files of an abandoned job: names that start with its stem and a dot, and not the output."""
    return """select j.job, f.name from (select o_orderkey as job, concat('doc', cast(o_orderkey as varchar(20))) as stem from orders where o_orderstatus = 'P') j
join (select l_orderkey, concat('doc', cast(l_orderkey as varchar(20)), case l_linenumber when 1 then '.md' when 2 then '.state' else concat('x.', cast(l_linenumber as varchar(20))) end) as name from lineitem) f
on f.l_orderkey = j.job and starts_with(f.name, concat(j.stem, '.')) and f.name <> concat(j.stem, '.md')""".replace("starts_with", "startswith" if d.name == "spark" else "starts_with")


@operator
def jobs_f45_newer(d):
    v = "concat('v', cast(p_size as varchar(20)), '.', cast(p_partkey % 20 as varchar(20)), '.x')"
    part = lambda i: f"coalesce(cast(nullif({d.extract(v, r'^v?([0-9]+)[.]([0-9]+)', i)}, '') as int), 0)"
    return f"select p_partkey, {part(1)} > 25 or ({part(1)} = 25 and {part(2)} > 7) as newer from part"


@operator
def jobs_f46_build_date(d):
    month, day = ("date_format(o_orderdate, 'MMMM')", "day(o_orderdate)") if d.name == "spark" else ("monthname(o_orderdate)", "day(o_orderdate)")
    return f"""select o_orderkey, concat({month}, ' ', cast({day} as varchar(20)), case when {day} in (11, 12, 13) then 'th' when {day} % 10 = 1 then 'st' when {day} % 10 = 2 then 'nd' when {day} % 10 = 3 then 'rd' else 'th' end, ', ', cast(year(o_orderdate) as varchar(20))) as shown from orders"""


@operator
def md_p14_contents(d):
    x = "concat(text, case doc_id % 4 when 0 then ' CHAPTER I one CHAPTER II two' when 1 then ' a — b — c — d' else '' end)"
    return f"select doc_id, {d.count(x, 'CHAPTER|CHAPITRE|KAPITEL')} >= 2 or ({x} like '% — %' and {d.count(x, '—')} >= 3) as contents from documents where text is not null"


@operator
def md_j10_free_sections(d):
    """Lines that start a section outside any chapter's span of its document."""
    return """with s as (select doc_id, line_index from v_block where length(line) > 40), c as (select doc_id, line_index as a, line_index + 4 as b from v_block where line_index % 12 = 0)
select s.doc_id, s.line_index from s where not exists (select 1 from c where c.doc_id = s.doc_id and s.line_index >= c.a and s.line_index < c.b)"""
