"""Readers and writers of the file formats around a run."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A whole file; no row where it is missing or cannot be parsed."""
    try:
        found = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return found.where(F.coalesce(*[F.col(c).isNotNull() for c in found.columns]))


def traces(rows: DataFrame, run_id: str = "", trace_id: str = "") -> DataFrame:
    """Trace lines of a run, or of a trace; empty ids match nothing."""
    hit = F.lit(False)
    if run_id:
        hit = hit | (F.col("run_id") == run_id)
    if trace_id:
        hit = hit | (F.col("trace_id") == trace_id)
    return rows.where(F.coalesce(hit, F.lit(False)))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """The different lines of a file in order of appearance: url, pos."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "url"))
    clean = lines.select(F.trim("url").alias("url"), "pos").where("url <> ''")
    return clean.groupBy("url").agg(F.min("pos").alias("pos")).orderBy("pos")


def skill_documents(spark: SparkSession, folder: str) -> DataFrame:
    """SKILL.md files: path, name, description, body; drafts and documents without name or description go."""
    files = spark.read.option("pathGlobFilter", "SKILL.md").option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1))
    out = files.select("path", field("name").alias("name"), field("description").alias("description"), F.regexp_replace("value", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "").alias("body"))
    return out.where(eligible_path(F.col("path")) & (F.col("name") != "") & (F.col("description") != ""))


def eligible_path(path: Column) -> Column:
    return ~path.rlike(r"/output/draft_skills/")


def sections(body: Column) -> Column:
    """The second-level sections of a markdown text: array of (title, text)."""
    parts = F.split(F.concat(F.lit("\n"), body), r"\n## +")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^\n]*)", 1)).alias("title"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("text")))


def write_committed(items: DataFrame, path: str) -> None:
    """Successful and durable items, sorted by URL, as JSON lines; the file set is replaced at the job's commit."""
    good = F.col("success") & (F.lower(F.trim("durability_state")) == "durable")
    items.where(good).repartitionByRange("url").sortWithinPartitions("url").write.mode("overwrite").json(path)


def write_if_changed(rows: DataFrame, path: str, ignore: tuple[str, ...] = ()) -> bool:
    """Replace a Parquet table only if its rows differ, the columns in ``ignore`` left out. Compared by an order-free digest of two hashes."""
    spark = rows.sparkSession
    columns = sorted(c for c in rows.columns if c not in ignore)

    def digest(df: DataFrame) -> tuple:
        h = F.xxhash64(*columns)
        return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h).cast("decimal(38,0)"))).first())

    try:
        old = spark.read.parquet(path)
        if set(columns) <= set(old.columns) and digest(old) == digest(rows):
            return False
    except AnalysisException:
        pass
    replace_table(rows, path)
    return True


def promote(spark: SparkSession, staged: str, final: str) -> None:
    """Put a written table in the place of another: the old one is moved aside, the staged one renamed, then the old one deleted.

    Any file system that Spark reads will do; where renames are atomic readers see the old or the new files.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, place, old = path(staged), path(final), path(f"{final.rstrip('/')}.old-{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(new):
        raise OSError(f"{staged} is not there")
    if place.getParent() is not None:
        fs.mkdirs(place.getParent())
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"{final} can't be moved aside")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"{staged} can't be moved to {final}")
    if had:
        fs.delete(old, True)


def replace_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write aside, then switch; rows may be read from ``path`` itself."""
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    rows.write.format(kind).save(staged)
    promote(rows.sparkSession, staged, path)


def write_idempotent(rows: DataFrame, path: str, identity: list[str], volatile: tuple[str, ...] = ("updated_at",), created: str = "created_at") -> bool:
    """Replace a Parquet table unless it holds the same rows, ``volatile`` and ``created`` columns left out.

    A row whose identity was there before keeps its ``created``, and all of its columns where nothing else changed.
    """
    spark = rows.sparkSession
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        replace_table(rows, path)
        return True
    told = [c for c in rows.columns if c not in (*identity, *volatile, created)]
    if set(rows.columns) != set(old.columns):
        replace_table(rows, path)
        return True
    before = old.select(*[F.col(c).alias(f"__i{i}") for i, c in enumerate(identity)], F.struct(*rows.columns).alias("__old"))
    same_identity = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__i{i}")) for i, c in enumerate(identity)])
    joined = rows.join(before, same_identity, "left")
    same = F.col("__old").isNotNull()
    for c in told:
        same = same & F.col(c).eqNullSafe(F.col(f"__old.{c}"))
    kept = {c: F.when(same, F.col(f"__old.{c}")).otherwise(F.coalesce(F.col(f"__old.{c}"), F.col(c)) if c == created else F.col(c)) for c in (*volatile, created) if c in rows.columns}
    counted = joined.agg(F.count("*").alias("n"), F.count_if(same).alias("same")).first()
    if counted.n == counted.same == old.count():
        return False
    replace_table(joined.select(*[kept.get(c, F.col(c)).alias(c) for c in rows.columns]), path)
    return True


def write_merged(items: DataFrame, subtasks: DataFrame, path: str, subtask: str, order: str, pos: str) -> None:
    """Items of all subtasks as JSON lines in order of plan and item, each with the number of its subtask; the old files are replaced."""
    rows = items.join(subtasks.select(subtask, F.col(order).alias("plan_order")), subtask)
    replace_table(rows.repartitionByRange("plan_order", pos).sortWithinPartitions("plan_order", pos), path, "json")


def scenarios(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Scenario settings of YAML or JSON files: a row each, checked. Settings are few and small; they are parsed on the driver.

    Every scenario needs an id and a truth file; thresholds are shares, a missing one takes its default.
    """
    schema = "id string, truth string, match_key string, field_matching map<string,string>, min_record_recall double, min_field_f1 double, max_steps int"
    out = []
    for r in spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("path")).toLocalIterator():
        found = _settings(r.value)
        truth, limits = found.get("ground_truth") or {}, found.get("thresholds") or {}
        row = ((found.get("scenario") or found).get("id"), truth.get("file"), truth.get("match_key"), {str(k): str(v) for k, v in (truth.get("field_matching") or {}).items()}, float(limits.get("min_record_recall", 0.8)), float(limits.get("min_field_f1", 0.7)), int(limits.get("max_steps", 50)))
        if not row[0] or not row[1] or not (0 <= row[4] <= 1 and 0 <= row[5] <= 1 and row[6] > 0):
            raise ValueError(f"{r.path}: not a scenario")
        out.append(row)
    return spark.createDataFrame(out, schema)


def _settings(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    return found if isinstance(found, dict) else {}


def write_traces(rows: DataFrame, path: str, most: int = 4000) -> None:
    """Append trace lines, long texts cut."""
    cut = {f.name: F.when(F.length(f.name) > most, F.concat(F.substring(f.name, 1, most), F.lit("..."))).otherwise(F.col(f.name)) for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    rows.withColumns(cut).write.mode("append").json(path)


def report(scenarios: DataFrame, most: int = 1000) -> str:
    """A markdown table of a small result: one row a scenario. More than ``most`` rows are an error."""
    lines = ["| " + " | ".join(scenarios.columns) + " |", "|" + "---|" * len(scenarios.columns)]
    rows = scenarios.orderBy(scenarios.columns[0]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} scenarios in a report")
    return "\n".join(lines + ["| " + " | ".join(map(str, r)) + " |" for r in rows]) + "\n"
