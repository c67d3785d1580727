"""Line commands, JSON commands, TSV data sets, configuration files and metric exports."""

from __future__ import annotations

import configparser
import json
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Verbs of the line protocol, an engine's letter before them or not, and the most words of a line.
VERBS = ("SET", "GET", "DEL", "MOD", "COUNT", "EXISTS")
PREFIX = r"(?i)^[RBHL](?=(SET|GET|DEL|MOD|COUNT|EXISTS)$)"
MAX_TOKENS = 128


def commands(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """op, key, value, valid of lines of a protocol of words between spaces; a value ends at the next space."""
    parts = F.split(F.trim(F.col(line)), " +")
    op = F.upper(F.regexp_replace(F.element_at(parts, 1), PREFIX, ""))
    needs = F.when(op == "COUNT", 1).when(op.isin("SET", "MOD"), 3).otherwise(2)
    return lines.select(*(keep or []), op.alias("op"), F.try_element_at(parts, F.lit(2)).alias("key"), F.try_element_at(parts, F.lit(3)).alias("value"), (op.isin(*VERBS) & (F.size(parts) >= needs) & (F.size(parts) <= MAX_TOKENS)).alias("valid"))


def json_commands(rows: DataFrame, data: str = "data") -> DataFrame:
    """Columns of rows, then type, key, value of a JSON command; values of any JSON type come as text."""
    return rows.select("*", F.from_json(data, "type string, key string, value string").alias("c")).select(*rows.columns, "c.type", "c.key", "c.value")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """key, value of tab-separated lines; lines with # are comments."""
    return spark.read.option("sep", "\t").option("comment", "#").schema("key string, value string").csv(path)


def parse_config(text: str, kind: str) -> dict:
    """A configuration tree from JSON, INI or TOML text."""
    if kind == "json":
        return json.loads(text)
    if kind == "toml":
        return tomllib.loads(text)
    if kind == "ini":
        parser = configparser.ConfigParser()
        parser.read_string(text)
        return {s: dict(parser[s]) for s in parser.sections()}
    raise ValueError(f"unknown configuration format {kind}")


def config_rows(spark: SparkSession, tree: dict) -> DataFrame:
    """path, value: the leaves of a tree, paths by dots, list places by number."""
    out: list[tuple[str, str]] = []

    def walk(node: object, path: str) -> None:
        items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else None
        if items is None:
            out.append((path, node if isinstance(node, str) else json.dumps(node)))
        else:
            for k, v in items:
                walk(v, f"{path}.{k}" if path else str(k))

    walk(tree, "")
    return spark.createDataFrame(out, "path string, value string")


def export_metrics(rows: DataFrame, kind: str, keep: list[str] | None = None) -> DataFrame:
    """line (after columns to keep): metrics (name, type, value) as text, json or prometheus lines."""
    name, value = F.col("name"), F.col("value").cast("string")
    lines: dict[str, Column] = {
        "text": F.concat(name, F.lit(": "), value),
        "json": F.to_json(F.struct("name", "type", "value")),
        "prometheus": F.concat(F.lit("# TYPE "), F.translate(name, ".-", "__"), F.lit(" "), F.col("type"), F.lit("\n"), F.translate(name, ".-", "__"), F.lit(" "), value),
    }
    return rows.select(*(keep or []), lines[kind].alias("line"))


def write_tsv(state: DataFrame, path: str) -> None:
    """key and value as tab-separated lines."""
    state.select(F.concat_ws("\t", "key", "value")).write.text(path)


def generated(spark: SparkSession, rows: int, seed: int = 0, keys: int | None = None, skew: float = 0.0) -> DataFrame:
    """key, value of a data set that depends on the seed alone: keys of 8 to 32 and values of 64 to 512 characters.

    With fewer keys than rows a row's key is drawn among them: evenly, or by rank to the power of -skew."""
    at = spark.range(rows)
    u = F.rand(seed)
    if keys is None:
        nr = F.col("id")
    elif skew:
        power = 1.0 - skew
        top = F.lit(float(keys))
        nr = F.floor(F.pow(top, u) - 1 if abs(power) < 1e-9 else F.pow(u * (F.pow(top, F.lit(power)) - 1) + 1, F.lit(1 / power)) - 1)
    else:
        nr = F.floor(u * keys)
    at = at.withColumn("nr", F.least(nr.cast("long"), F.lit((keys or rows) - 1)))
    digest = lambda name, i: F.md5(F.concat_ws(":", F.lit(f"{name}{i}"), F.lit(str(seed)), F.col("nr" if name == "key" else "id").cast("string")))
    size = lambda name, low, high: F.pmod(F.xxhash64(F.lit(name), F.lit(seed), F.col("nr" if name == "key" else "id")), F.lit(high - low + 1)) + low
    key = F.concat(F.lpad(F.hex("nr"), 8, "0"), F.substring(digest("key", 0), F.lit(1), (size("key", 8, 32) - 8).cast("int")))
    value = F.substring(F.concat(*(digest("value", i) for i in range(16))), F.lit(1), size("value", 64, 512).cast("int"))
    return at.select(key.alias("key"), value.alias("value"))


#: Lines are cut into up to 2 ** CUTS ranges; a task gets about so many lines.
CUTS, LINES = 10, 200_000


def pieces(lines: DataFrame, nr: str) -> tuple[DataFrame, int]:
    """lines with piece: which of 2 ** CUTS ranges nr lies in, between quantiles of all lines; and the number of tasks for so many lines.
    A row's piece depends on its nr alone. An nr that isn't a number or a time has no quantiles; those lines are all in piece 0."""
    cuts = isinstance(lines.schema[nr].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    found = lines.agg(F.count("*").alias("n"), *([F.percentile_approx(nr, [i / 2**CUTS for i in range(1, 2**CUTS)]).alias("edges")] if cuts else []))
    known = found.first()
    tasks = max(1, -(-known["n"] // LINES))
    out = lines.withColumn("piece", F.lit(0))
    if not cuts:
        return out, tasks
    edges = lines.sparkSession.createDataFrame([(known["edges"],)], T.StructType([found.schema["edges"]]))
    out = out.crossJoin(F.broadcast(edges))  # one row
    for step in (2**i for i in reversed(range(CUTS))):  # a binary search
        out = out.withColumn("piece", F.col("piece") + F.when(F.get("edges", F.col("piece") + (step - 1)) <= F.col(nr), step).otherwise(0))
    return out.drop("edges"), tasks


def server_sent_events(lines: DataFrame, nr: str = "nr", line: str = "value") -> DataFrame:
    """stream, id, event, data of streams of lines (stream, nr, value) as servers send them: an empty line ends an event; several data
    lines are joined by line breaks; lines that begin with a colon are comments. Each stream is read in order, in pieces: a line's block
    is the number of empty lines in the pieces before its own and before it in its own."""
    cut, tasks = pieces(lines.select(F.struct("stream").alias("of"), nr, line), nr)  # a struct, so that a null stream is one too
    ending = (F.col(line) == "").cast("long")
    every = Window.partitionBy("of")
    sums = cut.groupBy("of", "piece").agg(F.coalesce(F.sum(ending), F.lit(0)).alias("n"))  # a row a piece
    sums = sums.select("of", "piece", F.coalesce(F.sum("n").over(every.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.sum("n").over(every).alias("ends"))
    within = Window.partitionBy("of", "piece").orderBy(nr).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.repartition(tasks, "of", "piece").withColumn("inside", F.coalesce(F.sum(ending).over(within), F.lit(0))).join(sums.repartition(tasks, "of", "piece"), ["of", "piece"])  # dealt out alike, or the lines would go by stream
    field = F.regexp_extract(line, r"^([^:]*)", 1)
    rest = F.regexp_replace(F.col(line), r"^[^:]*:? ?", "")
    ended = parts.withColumn("block", F.col("earlier") + F.col("inside")).where((F.col(line) != "") & (F.col("block") < F.col("ends")))
    named = ended.select("of", "block", nr, field.alias("field"), rest.alias("rest")).where("field <> ''")
    one = lambda name: F.max_by(F.when(F.col("field") == name, F.col("rest")), F.when(F.col("field") == name, F.col(nr)))
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "data", F.struct(nr, "rest")))), lambda x: x["rest"]), "\n")
    return named.repartition(tasks, "of", "block").groupBy("of", "block").agg(one("id").alias("id"), F.coalesce(one("event"), F.lit("message")).alias("event"), data.alias("data"), F.count_if(F.col("field") == "data").alias("n")).where("n > 0").select("of.stream", "id", "event", "data")


def load_document(samples: DataFrame, time: str, order: str, k: int) -> DataFrame:
    """json: the last k samples as one document; k bounds its size."""
    last = samples.orderBy(F.desc(time), F.desc(order)).limit(k)
    fields = [c for c in samples.columns if c != order]
    return last.agg(F.to_json(F.collect_list(F.struct(*fields)), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"))
