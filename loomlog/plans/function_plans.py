"""Queries of functions: hashes, digests, encryption, encodings, times, enums, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, scalar, security
from ..model import orders_state, read
from ..sources import text
from .base import STATE, query


@query()
def seeded_hashes(spark, d):
    key = F.col("key")
    return orders_state(spark, d).select("key", *(hashing.hashed(key, kind, 7).alias(kind) for kind in hashing.KINDS))


@query("""
WITH n AS (SELECT n_name AS name, encode(n_name) AS v, encode('salt') AS k FROM nation),
p AS (SELECT name, v, list_transform(range(64), lambda i: CASE WHEN i < 4 THEN ascii('salt'[i + 1]) ELSE 0 END) AS k FROM n),
h AS (SELECT name, v, list_aggregate(list_transform(k, lambda b: printf('%02x', xor(b, 54))), 'string_agg', '') AS i, list_aggregate(list_transform(k, lambda b: printf('%02x', xor(b, 92))), 'string_agg', '') AS o FROM p)
SELECT name, sha256(unhex(o) || unhex(sha256(unhex(i) || v))) AS hmac, true AS agrees FROM h""")
def hmac_digests(spark, d):
    name = F.col("n_name")
    rows = read(spark, d, "nation").select(name.alias("name"), security.hmac_sha256(name, b"salt").alias("hmac"), security.hmac_hex(name, b"salt").alias("other"))
    return rows.select("name", "hmac", (F.col("hmac") == F.col("other")).alias("agrees"))


@query()
def more_digests(spark, d):
    name = F.col("n_name")
    return read(spark, d, "nation").select(name.alias("name"), security.sha512_hex(name).alias("sha512"), security.blake2b_hex(name).alias("blake2b"), security.pbkdf2_hex(name, b"salt", 10).alias("pbkdf2"))


@query("SELECT n_name AS name, n_name AS gcm, n_name AS cbc, true AS hidden FROM nation")
def encrypt_round_trip(spark, d):
    name, key = F.col("n_name"), F.lit(b"0123456789abcdef")
    rows = read(spark, d, "nation").select(name.alias("name"), *(security.encrypted(name, key, m).alias(m) for m in ("GCM", "CBC")))
    return rows.select("name", *(security.decrypted(F.col(m), key, m).cast("string").alias(m.lower()) for m in ("GCM", "CBC")), ((F.col("GCM") != F.col("name").cast("binary")) & (F.col("CBC") != F.col("GCM"))).alias("hidden"))


@query("SELECT n_name AS name, n_name AS decoded, CAST(NULL AS VARCHAR) AS wrong FROM nation")
def base64_decode(spark, d):
    name = F.col("n_name")
    return read(spark, d, "nation").select(name.alias("name"), security.from_base64(F.base64(name.cast("binary"))).cast("string").alias("decoded"), security.from_base64(F.concat(name, F.lit("*!"))).cast("string").alias("wrong"))


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS parsed, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01') AS elapsed FROM orders")
def time_parse(spark, d):
    day = F.col("o_orderdate")
    parsed = scalar.parsed_time(F.date_format(day, "dd/MM/yyyy HH:mm"), "%d/%m/%Y %H:%M")
    return read(spark, d, "orders").select("o_orderkey", parsed.alias("parsed"), scalar.elapsed_ms(F.lit("1995-01-01").cast("timestamp_ntz"), day).alias("elapsed"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Follower' WHEN 1 THEN 'Candidate' WHEN 2 THEN 'Leader' ELSE 'Unknown' END AS role FROM events")
def enum_names(spark, d):
    return read(spark, d, "events").select("event_id", scalar.enum_name(F.col("event_id") % 4, ["Follower", "Candidate", "Leader"]).alias("role"))


@query("SELECT o_orderkey, (SELECT min(p) FROM (SELECT CAST(1 AS BIGINT) << i AS p FROM range(40) r(i)) WHERE p >= o_orderkey) AS power, list_min([5, CAST(o_orderkey AS INTEGER)]) AS least, ltrim('  x ') || rtrim(' y  ') AS trimmed FROM orders")
def math_helpers(spark, d):
    key = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", scalar.next_power_of_two(key).alias("power"), F.least(F.lit(5), key.cast("int")).alias("least"), F.concat(scalar.left_trimmed(F.lit("  x ")), scalar.right_trimmed(F.lit(" y  "))).alias("trimmed"))


@query("SELECT count(*) AS rows, true AS whole, true AS lengths, true AS ids FROM orders")
def random_values(spark, d):
    rows = read(spark, d, "orders").select(scalar.random_int(1, 6, 3).alias("n"), scalar.random_string(12, 4).alias("s"), F.uuid().alias("id"))
    return rows.agg(F.count("*").alias("rows"), F.bool_and(F.col("n").between(1, 6)).alias("whole"), F.bool_and(F.length("s") == 12).alias("lengths"), F.bool_and(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("ids"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'SET' END AS type, 'user:' || user_id AS key, event_type AS value FROM events")
def json_commands(spark, d):
    data = F.to_json(F.struct(F.when(F.col("event_type") == "error", "DEL").otherwise("SET").alias("type"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value")))
    return text.json_commands(read(spark, d, "events").select("event_id", data.alias("data"))).drop("data")


@query(f"SELECT line, op, key, value, valid FROM (SELECT key AS k, unnest(['rset ' || key || ' v', 'GET ' || key, 'Hmod ' || key, 'xyz ' || key, 'COUNT', 'lexists ' || key]) AS line, unnest(['SET', 'GET', 'MOD', 'XYZ', 'COUNT', 'EXISTS']) AS op, unnest([key, key, key, key, NULL, key]) AS key, unnest(['v', NULL, NULL, NULL, NULL, NULL]) AS value, unnest([true, true, false, false, true, true]) AS valid FROM {STATE} WHERE key < 'order:00000050')")
def protocol_lines(spark, d):
    forms = F.array(*(F.concat(F.lit(a), "key", F.lit(b)) for a, b in (("rset ", " v"), ("GET ", ""), ("Hmod ", ""), ("xyz ", ""), ("lexists ", ""))), F.lit("COUNT"))
    lines = orders_state(spark, d).where("key < 'order:00000050'").select(F.explode(forms).alias("value"))
    return text.commands(lines.withColumn("line", F.col("value")), keep=["line"])


@query("SELECT event_type || ': ' || event_id AS line, event_id, 'text' AS kind FROM events UNION ALL SELECT '# TYPE ' || event_type || ' gauge' || chr(10) || event_type || ' ' || event_id, event_id, 'prometheus' FROM events UNION ALL SELECT CAST(json_object('name', event_type, 'type', 'gauge', 'value', event_id) AS VARCHAR), event_id, 'json' FROM events")
def metric_lines(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.lit("gauge").alias("type"), F.col("event_id").alias("value"))
    out = [text.export_metrics(rows, kind, keep=["event_id"]).withColumn("kind", F.lit(kind)) for kind in ("text", "prometheus", "json")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT 's' || (user_id % 3) AS stream, CAST(event_id AS VARCHAR) AS id, event_type AS event, 'a' || event_id || chr(10) || 'b' AS data FROM events")
def sse_events(spark, d):
    block = F.array(F.concat(F.lit("id: "), "event_id"), F.lit(": a comment"), F.concat(F.lit("event: "), "event_type"), F.concat(F.lit("data: a"), "event_id"), F.lit("data:b"), F.lit(""))
    lines = read(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id") % 3).alias("stream"), "event_id", F.posexplode(block).alias("at", "value"))
    return text.server_sent_events(lines.select("stream", (F.col("event_id") * 10 + F.col("at")).alias("nr"), "value"))


@query("SELECT 400 AS rows, 400 AS keys, true AS key_lengths, true AS value_lengths, 400 AS read_back")
def generated_data(spark, d):
    from ..session import workspace

    rows = text.generated(spark, 400, 5)
    path = workspace(spark, "tsv")
    text.write_tsv(rows, path)
    back = text.read_tsv(spark, path).join(rows, ["key", "value"], "left_semi").agg(F.count("*").cast("int").alias("read_back"))
    seen = rows.agg(F.count("*").cast("int").alias("rows"), F.count_distinct("key").cast("int").alias("keys"), F.bool_and(F.length("key").between(8, 32)).alias("key_lengths"), F.bool_and(F.length("value").between(64, 512)).alias("value_lengths"))
    return seen.crossJoin(back)  # one row each
