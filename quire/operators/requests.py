"""Requests, glossaries, licences and caches as operators on tables.

Nulls count as missing values and are refused or skipped as each operator says; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Other names of targets, the targets with their ISO codes, texts of a request, licences for commercial use.
TARGET_ALIASES = {"EN": "EN-GB", "PT": "PT-PT"}
TARGETS = {"DE": "de", "EN-GB": "en", "EN-US": "en", "IT": "it", "PT-PT": "pt", "PT-BR": "pt"}
MOST_TEXTS = 50
LICENCES = ("Apache-2.0", "CC-BY-4.0")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def glossary_rows(files: DataFrame, separator: str = "\t") -> DataFrame:
    """(glossary, line, source, target, error) of the lines of (glossary, text). Blank lines are skipped; a line with
    fewer than two cells or an empty one is an error with its number; cells are trimmed."""
    lines = files.where("text is not null").select("glossary", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "row"))
    if separator == ",":  # quoted cells keep their commas
        cells = F.from_csv("row", "source string, target string", {"sep": ",", "mode": "PERMISSIVE"})
        rows = lines.select("glossary", "at", "row", cells.alias("c")).select("glossary", "at", "row", "c.source", "c.target")
    else:
        parts = F.split("row", separator, -1)
        rows = lines.select("glossary", "at", "row", F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("target"))
    rows = rows.where(~F.regexp_replace("row", r"[\s,]" if separator == "," else r"\s", "").isin(""))
    source, target = (F.trim(F.coalesce(c, F.lit(""))) for c in ("source", "target"))
    bad = (source == "") | (target == "")
    line = (F.col("at") + 1).cast("bigint")
    error = F.when(bad, F.concat(F.lit("line "), line.cast("string"), F.lit(" is no glossary entry: "), F.col("row")))
    return rows.select("glossary", line.alias("line"), F.when(~bad, source).alias("source"), F.when(~bad, target).alias("target"), error.alias("error"))


def glossary_entries(rows: DataFrame) -> DataFrame:
    """(glossary, source, target) of glossaries without an error; of a source's lines the last one counts."""
    broken = rows.where("error is not null").select("glossary").distinct()
    last = rows.join(broken, "glossary", "left_anti").groupBy("glossary", "source").agg(F.max_by("target", "line").alias("target"))
    return last.select("glossary", "source", "target")


def coerce_entries(values: DataFrame) -> DataFrame:
    """(glossary, source, target, error) from (glossary, value), a text that holds a JSON object, a JSON list of pairs or of
    {source, target}, or lines with tabs. A text that begins like JSON but is none is an error; null and blank have no entries."""
    value = F.trim("value")
    kinds = values.select("glossary", value.alias("v")).where("v is not null and v <> ''")
    from_map = F.map_entries(F.from_json("v", "map<string,string>"))
    pairs = F.transform(F.from_json("v", "array<array<string>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")))
    named = F.transform(F.from_json("v", "array<struct<source:string,target:string>>"), lambda p: F.struct(p["source"].alias("key"), p["target"].alias("value")))
    got = F.when(F.col("v").startswith("{"), from_map).when(F.col("v").rlike(r"^\[\s*\["), pairs).when(F.col("v").rlike(r"^\[\s*(\{|\])"), named)
    json = kinds.where(F.col("v").rlike(r"^[\[{]")).select("glossary", got.alias("e"))
    entry = json.select("glossary", F.posexplode_outer("e").alias("at", "p"), F.col("e").isNull().alias("none"))
    clean = entry.select("glossary", "at", F.trim("p.key").alias("source"), F.trim("p.value").alias("target"), F.when(F.col("none"), F.lit("not a glossary in JSON")).alias("error"))
    some = clean.where("error is not null or (source <> '' and target <> '')")
    last = some.groupBy("glossary", "source", "error").agg(F.max_by("target", "at").alias("target")).select("glossary", "source", "target", "error")
    rows = glossary_rows(kinds.where(~F.col("v").rlike(r"^[\[{]")).select("glossary", F.col("v").alias("text")))
    plain = glossary_entries(rows).withColumn("error", F.lit(None).cast("string"))
    return last.unionByName(plain).unionByName(rows.where("error is not null").select("glossary", "source", "target", "error"))


def glossary_store(log: DataFrame) -> DataFrame:
    """The glossaries that a log of (glossary_id, at, action, entries) leaves: the last create of each that no later delete follows."""
    last = log.groupBy("glossary_id").agg(F.max_by(F.struct("action", "at", "entries"), F.struct("at", "action")).alias("r"))
    return last.where("r.action = 'create'").select("glossary_id", F.col("r.at").alias("created"), F.col("r.entries").alias("entries"))


def validate_requests(requests: DataFrame, supported: list[str]) -> DataFrame:
    """H1: (request_id, target, iso, status, message) from (request_id, text array, source_lang, target_lang): the first rule of the
    decision table that a request breaks tells its status; 200 if it breaks none."""
    code = F.upper(F.trim(F.coalesce("target_lang", F.lit(""))))
    code = F.coalesce(_lookup(TARGET_ALIASES, code), code)
    iso = _lookup(TARGETS, code)
    rules = [
        (F.col("text").isNull() | (F.size("text") == 0), "parameter 'text' not specified"),
        (F.exists("text", lambda x: x.isNull()), "'text' must hold strings"),
        (F.size("text") > MOST_TEXTS, f"more than {MOST_TEXTS} texts"),
        (F.coalesce(F.upper(F.trim("source_lang")), F.lit("FR")) != "FR", "only FR is a source"),
        (code == "", "parameter 'target_lang' not specified"),
        (iso.isNull(), "value for 'target_lang' not supported"),
        (~iso.isin(*supported), "target not available with this engine"),
    ]
    message = F.coalesce(*[F.when(broken, F.lit(said)) for broken, said in rules])
    return requests.select("request_id", code.alias("target"), iso.alias("iso"), F.when(message.isNull(), 200).otherwise(400).alias("status"), message.alias("message"))


def available_targets(targets: Column) -> Column:
    """U4: the codes of targets, in order, whose language an engine has."""
    return F.filter(F.array(*[F.when(F.array_contains(targets, iso), F.lit(code)) for code, iso in TARGETS.items()]), lambda x: x.isNotNull())


def allowed_engines(engines: DataFrame) -> DataFrame:
    """The engines (key, model_id, license, ...) with a licence for commercial use; one whose key or model is of the
    non-commercial family is refused whatever it declares."""
    refused = F.lower(F.concat_ws(" ", "key", "model_id")).contains("nllb") | F.lower("key").isin("precise", "fast", "turbo")
    return engines.where(F.col("license").isin(*LICENCES) & ~F.coalesce(refused, F.lit(False)))


def content_refused(message: Column) -> Column:
    """An engine's error that tells of its content filter."""
    return F.coalesce(F.contains(F.lower(message), F.lit("content filtering")), F.lit(False))


def memoised(texts: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, cache to keep) for rows (text): what the cache of (text, output) has is taken from there, ``compute`` gets each other distinct
    text once, and the cache grows by its answers."""
    wanted = texts.select("text").where("text is not null").distinct()
    grown = cache.select("text", "output").unionByName(compute(wanted.join(cache, "text", "left_anti")).select("text", "output"))
    return texts.join(grown, "text", "left"), grown


def kept_lines(lines: DataFrame, banned: DataFrame, keep: DataFrame) -> DataFrame:
    """Lines whose ``key`` is not banned, or is but stands in the list of those to keep."""
    return lines.join(banned.join(keep, "key", "left_anti").select("key").distinct(), "key", "left_anti")


def resumable(pending: DataFrame, pointers: DataFrame, states: DataFrame) -> DataFrame:
    """Pending jobs (output_path) with a pointer (output_path, work_dir), whose state (work_dir, source_hash, hash_now, done, total) is unfinished and
    of the source as it is now; of several pointers the last by work_dir."""
    latest = pointers.groupBy("output_path").agg(F.max("work_dir").alias("work_dir"))
    fit = states.where("done < total and source_hash = hash_now").select("work_dir", "done", "total")
    return pending.select("output_path").distinct().join(latest, "output_path").join(fit, "work_dir").select("output_path", "work_dir", "done", "total")


def undo_backups(backups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(restored, left) from (path, version, content, undo): the first backup of a path is the one that is kept; where an undo is asked for, its
    content comes back and no backup is left."""
    first = backups.groupBy("path").agg(F.min_by(F.struct("version", "content"), "version").alias("r"), F.max("undo").alias("undo"))
    rows = first.select("path", "r.version", "r.content", F.coalesce("undo", F.lit(False)).alias("undo"))
    return rows.where("undo").select("path", "content"), rows.where("not undo").select("path", "version", "content")


def cache_dirs(files: DataFrame, name: str = ".work") -> DataFrame:
    """(dir, n_files, bytes) of the work folders called ``name`` from (path, length), as ``binaryFile`` lists them."""
    folder = F.regexp_extract("path", rf"^(.*?/\Q{name}\E)/", 1)
    return files.select(folder.alias("dir"), "length").where("dir <> ''").groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


#: Fixed value: bytes of a cached model that is whole.
READY_BYTES = 50_000_000


def model_ready(models: DataFrame) -> DataFrame:
    """(repo, cached, ready) from (repo, bytes, converted): whole in the cache, or converted."""
    cached = F.coalesce(F.col("bytes") >= READY_BYTES, F.lit(False))
    return models.select("repo", cached.alias("cached"), (cached | F.coalesce("converted", F.lit(False))).alias("ready"))
