"""Readers of configuration, run folders and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import urls


def site_list(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """(url, description, prompt, notes) of a JSON file {"sites": [...]}; with `only` that site, known or not."""
    schema = "sites array<struct<url string, description string, prompt string, notes string>>"
    sites = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("sites"))
    if only is None:
        return sites
    asked = spark.range(1).select(F.lit(only).alias("url"))
    return asked.join(sites, "url", "left").select("url", "description", "prompt", "notes")


def run_folders(spark: SparkSession, base: str) -> DataFrame:
    """(run, config, log, report, result) of every run folder that has a config.json, the newest name first; log.json goes before log.txt."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(base).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = files.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "value")
    wide = parts.groupBy("run").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(a) for n, a in (("config.json", "config"), ("log.json", "log_json"), ("log.txt", "log_txt"), ("summary.md", "report"), ("result.json", "result"))]
    )
    return wide.where("config is not null").select("run", "config", F.coalesce("log_json", "log_txt").alias("log"), "report", "result").orderBy(F.col("run").desc())


def report_figures(runs: DataFrame) -> DataFrame:
    """(run, items, has_error): the number of items and whether a report names an error; a line that says none is no error."""
    lines = F.split("report", "\n")
    items = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"^\s*Items\s*:")), F.lit(1))
    errors = F.filter(lines, lambda x: x.rlike(r"^\s*Error\s*:") & ~F.lower(x).contains("none"))
    return runs.select("run", F.regexp_extract(items, r":\s*(\d+)", 1).try_cast("int").alias("items"), (F.size(errors) > 0).alias("has_error"))


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages that the rules (host, prefix, allow) of their host permit: the longest matching prefix holds, none permits."""
    at = pages.withColumns({"host_": urls.host(F.col("url")), "path_": urls.path(F.col("url"))})
    matched = at.join(rules.withColumnRenamed("host", "host_"), "host_", "left")
    fits = F.when(F.col("path_").startswith(F.col("prefix")), F.struct(F.length("prefix").alias("n"), "allow"))
    judged = matched.groupBy("page_id").agg(F.max(fits).alias("best"))
    return pages.join(judged.where(F.coalesce("best.allow", F.lit(True))).select("page_id"), "page_id", "left_semi")


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, record): the records (VARIANT) of every JSON file of a folder that holds an array; one row without a record for other files."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    records = F.try_variant_get("v", "$", "array<variant>")
    return texts.select("file", F.posexplode_outer(records).alias("idx", "record"))


def archive_exports(spark: SparkSession, base: str) -> DataFrame:
    """(export, exported_at, session_count) of every export folder with a sessions.json, the newest first; a count that is no integer and a date that is no text are null, the folder's name stands in for the date."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(base).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    named = texts.where(F.regexp_extract("path", r"([^/]+)$", 1) == "sessions.json").withColumn("export", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))

    def given(name: str, kind: str, cast: str) -> Column:
        member = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(member).rlike(kind), F.try_variant_get(member, "$", cast))

    return named.select("export", F.coalesce(given("exported_at", "^STRING$", "string"), "export").alias("exported_at"), given("session_count", "INT$", "bigint").alias("session_count")).orderBy(F.col("export").desc())


def write_export(lines: DataFrame, path: str) -> None:
    """Writes an export's lines in order as text files, into a new folder only."""
    lines.orderBy("pos").select("line").write.mode("errorifexists").text(path)


def write_run_artifacts(events: DataFrame, path: str) -> None:
    """Writes each run's events as JSON lines and its display lines as text, a folder for each run, in the order of the events."""
    numbered = events.repartitionByRange("run_id", "id").sortWithinPartitions("run_id", "id")
    numbered.drop("line").write.mode("errorifexists").partitionBy("run_id").json(f"{path}/log_json")
    numbered.select("run_id", F.coalesce("line", F.lit("")).alias("line")).write.mode("errorifexists").partitionBy("run_id").text(f"{path}/log_txt")


def robots_rules(texts: DataFrame) -> DataFrame:
    """(host, prefix, allow): the rules for all crawlers in the robots.txt of each host (host, text); an empty Disallow allows all, unreadable texts give none."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$", "")))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    # A record's agents stand before its rules: an agent line behind a rule begins a new record.
    start = F.struct(F.lit(False).alias("ours"), F.lit(False).alias("ruled"), F.array().cast("array<struct<allow: boolean, prefix: string>>").alias("rules"))

    def step(s: Column, p: Column) -> Column:
        agent, rule = p.k == "user-agent", p.k.isin("allow", "disallow")
        ours = F.when(agent, (~s.ruled & s.ours) | (p.v == "*")).otherwise(s.ours)
        ruled = F.when(agent, F.lit(False)).otherwise(s.ruled | rule)
        rules = F.when(rule & s.ours & (p.v != ""), F.concat(s.rules, F.array(F.struct((p.k == "allow").alias("allow"), p.v.alias("prefix"))))).otherwise(s.rules)
        return F.struct(ours.alias("ours"), ruled.alias("ruled"), rules.alias("rules"))

    found = texts.where("text is not null").select("host", F.explode(F.reduce(pairs, start, step).rules).alias("r"))
    return found.select("host", "r.prefix", "r.allow")
