"""Flows: parsers of raw logs, and the mapping of the events table onto the flow schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the raw logs, in order.
CONN_FIELDS = "ts uid src_ip src_port dst_ip dst_port proto service duration orig_bytes resp_bytes conn_state local_orig local_resp missed_bytes history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes tunnel_parents ip_proto".split()
CONN_NUMBERS = "ts duration orig_bytes resp_bytes missed_bytes orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes".split()
DNS_FIELDS = "ts uid src_ip src_port dst_ip dst_port proto trans_id rtt query qclass qclass_name qtype qtype_name rcode rcode_name AA TC RD RA Z answers TTLs rejected".split()
SSL_FIELDS = "ts uid src_ip src_port dst_ip dst_port version cipher curve server_name resumed last_alert next_protocol established ssl_history cert_chain client_cert_chain subject issuer client_subject client_issuer validation_status sni_matches".split()

#: Times of the mapped flows in microseconds: most sources spread over 1.8 h, four attack-shaped ones are denser.
TS_US = "CASE s WHEN 3 THEN 3000000000 + d {div} 4000 WHEN 5 THEN 3600000000 + d {div} 16000 WHEN 7 THEN 4200000000 + d {div} 8000 WHEN 9 THEN 4800000000 + d {div} 4000 ELSE d {div} 400 END"
COLUMNS = {
    "src_ip": "concat('192.168.50.', CAST(10 + s AS {string}))",
    "dst_ip": "CASE WHEN event_id % 41 = 0 THEN '224.0.0.251' WHEN event_id % 7 = 0 THEN '192.168.50.1' WHEN s = 9 THEN concat('203.0.113.', CAST(event_id % 2 AS {string})) ELSE concat('203.0.113.', CAST(event_id % 60 AS {string})) END",
    "dst_port": "CASE WHEN event_id % 53 = 0 THEN 5353 WHEN s = 3 THEN 1000 + event_id % 900 WHEN s = 7 THEN 53 WHEN s = 9 THEN CASE WHEN event_id % 2 = 0 THEN 22 ELSE 2222 END WHEN event_type = 'click' THEN 443 WHEN event_type = 'view' THEN 80 WHEN event_type = 'signup' THEN 53 WHEN event_type = 'purchase' THEN 1000 + k ELSE 22 END",
    "conn_state": "CASE WHEN event_type = 'error' OR s = 9 THEN CASE WHEN event_id % 2 = 0 THEN 'REJ' ELSE 'S0' END ELSE 'SF' END",
    "orig_bytes": "CAST(floor(value * 100) AS BIGINT)",
    "resp_bytes": "CAST(floor(value * 37) AS BIGINT)",
    "duration": "event_id % 97",
}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as flows: event_id, ts_us, src_ip, dst_ip, dst_port, proto, service, conn_state, orig_bytes, resp_bytes, duration."""
    return flows_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def live_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of flows; the glob lets the table be one file or a folder of files."""
    return flows_of(spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*"))


def flows_of(events: DataFrame) -> DataFrame:
    base = events.selectExpr("event_id", "event_type", "value", "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', CAST(ts AS TIMESTAMP_NTZ)) AS d", "user_id % 12 AS s", "coalesce(CAST(get_json_object(props, '$.k') AS BIGINT), 0) AS k")
    mapped = base.selectExpr("event_id", f"{TS_US.format(div='DIV')} AS ts_us", *[f"{e.format(string='STRING')} AS {c}" for c, e in COLUMNS.items()])
    return mapped.withColumns({"dst_port": F.col("dst_port").cast("long"), "proto": F.when(F.col("dst_port") == 53, "udp").otherwise("tcp"), "service": F.when(F.col("dst_port") == 53, "dns").when(F.col("dst_port") == 22, "ssh").otherwise("-")})


FLOWS_SQL = f"""
flow_base AS (SELECT event_id, event_type, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS d, user_id % 12 AS s, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events),
flows AS (SELECT event_id, CAST({TS_US.format(div="//")} AS BIGINT) AS ts_us, {", ".join(f"{'CAST(' if c == 'dst_port' else ''}{e.format(string='VARCHAR')}{' AS BIGINT)' if c == 'dst_port' else ''} AS {c}" for c, e in COLUMNS.items())} FROM flow_base)"""


# Raw text logs


def _fields(lines: DataFrame, fields: list[str], least: int, most: int, numbers: list[str]) -> DataFrame:
    parts = F.split(F.trim("value"), "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(parts.alias("p")).filter((F.size("p") >= least) & (F.size("p") <= most))
    value = lambda i: F.nullif(F.get("p", F.lit(i)), F.lit("-"))
    return rows.select(*[(value(i).try_cast("double") if f in numbers else value(i)).alias(f) for i, f in enumerate(fields)])


def parse_conn_log(lines: DataFrame) -> DataFrame:
    """Connection log lines (column value): rows of exactly 22 fields, '-' is null, bad numbers are null."""
    return _fields(lines, CONN_FIELDS, 22, 22, CONN_NUMBERS)


def parse_dns_log(lines: DataFrame) -> DataFrame:
    return _fields(lines, DNS_FIELDS, 24, 24, ["ts"])


def parse_ssl_log(lines: DataFrame) -> DataFrame:
    """TLS log lines: 14 fields or more, padded with nulls."""
    return _fields(lines, SSL_FIELDS, 14, 1 << 20, ["ts"])


_FAILS = (r"Failed \S+ for (?:invalid user )?(\S+) from (\S+)", r"Invalid user (\S+) from (\S+)", r"authentication failure;.*rhost=(\S+)(?:\s+user=(\S+))?")
_ACCEPT = r"Accepted \S+ for (\S+) from (\S+)"


def parse_auth_log(lines: DataFrame) -> DataFrame:
    """(line, outcome, user, ip) of SSH login lines; other lines go, and so do failures from local addresses."""
    line = F.col("value")
    get = lambda p, i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    ip = F.coalesce(get(_FAILS[0], 2), get(_FAILS[1], 2), get(_FAILS[2], 1))
    user = F.coalesce(get(_FAILS[0], 1), get(_FAILS[1], 1), get(_FAILS[2], 2))
    good = get(_ACCEPT, 2)
    rows = lines.select(line.alias("line"), F.when(ip.isNotNull(), "fail").when(good.isNotNull(), "success").alias("outcome"), F.when(ip.isNotNull(), user).otherwise(get(_ACCEPT, 1)).alias("user"), F.coalesce(ip, good).alias("ip"))
    return rows.filter(F.col("outcome").isNotNull() & ~((F.col("outcome") == "fail") & F.expr("ip LIKE '192.168.%' OR ip LIKE '10.%' OR ip LIKE '127.%'")))


def parse_firewall_log(lines: DataFrame, prefix: str = "FW_WAN") -> DataFrame:
    """(src, dst, dst_port, proto, interface) of kernel lines with the prefix; the last of repeated keys wins; rows without SRC, DST or an integer DPT go."""
    key = lambda k: F.nullif(F.regexp_extract("value", rf"(?:.*[\s]|^){k}=(\S*)", 1), F.lit(""))
    rows = lines.filter(F.col("value").contains(prefix)).select(key("SRC").alias("src"), key("DST").alias("dst"), key("DPT").try_cast("int").alias("dst_port"), F.coalesce(key("PROTO"), F.lit("unknown")).alias("proto"), F.coalesce(key("IN"), F.lit("unknown")).alias("interface"))
    return rows.filter("src IS NOT NULL AND dst IS NOT NULL AND dst_port IS NOT NULL")


def write_alerts(alerts: DataFrame, path: str, today: Column | None = None) -> None:
    """Append alerts as JSON lines in a folder for each alert date; bad times go to today's, missing fields get defaults."""
    now = today if today is not None else F.current_date()
    defaults = {"source": "flowsentry", "severity": "INFO", "alert_type": "unknown"}
    rows = alerts
    for c, v in defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in alerts.columns else F.lit(v))
    rows.withColumn("date", F.coalesce(F.to_date(F.try_to_timestamp(F.col("time"))), now)).write.mode("append").partitionBy("date").json(path)


def read_alerts(lines: DataFrame, fields: str = "time string, source string, severity string, alert_type string") -> DataFrame:
    """JSON lines as columns; lines that are no JSON object stay as text of type legacy-log."""
    parsed = F.from_json("value", fields)
    known = F.col("value").rlike(r"^\s*\{") & parsed.isNotNull()
    names = [f.split()[0] for f in fields.split(", ")]
    return lines.select(*[(F.when(known, parsed[n]).otherwise(F.lit("legacy-log")) if n == "alert_type" else F.when(known, parsed[n])).alias(n) for n in names], F.when(~known, F.col("value")).alias("text"))


def read_daily(spark: SparkSession, folder: str, days: list[str] | None = None, last: int | None = None) -> DataFrame:
    """Daily Parquet folders date=YYYY-MM-DD under folder, as one table with its source date: those of days, or the last so many days."""
    rows = spark.read.option("mergeSchema", "true").option("basePath", folder).parquet(folder).withColumn("date", F.col("date").cast("string"))
    if days is not None:
        rows = rows.filter(F.col("date").isin(*days))
    if last is not None:
        newest = rows.select("date").distinct().orderBy(F.desc("date")).limit(last)
        rows = rows.join(F.broadcast(newest), "date")  # a row a day
    return rows.withColumnRenamed("date", "source_date")


def write_baselines(profiles: DataFrame, path: str) -> None:
    """Baselines as JSON, one document a source: its measures under its address."""
    measures = F.struct(*[c for c in profiles.columns if c != "src_ip"])
    profiles.select(F.create_map("src_ip", measures).alias("per_ip")).write.json(path)


def read_baselines(spark: SparkSession, path: str, measures: str) -> DataFrame:
    """Baselines of JSON documents of either shape: a map of sources under per_ip, or the map itself."""
    kind = f"map<string, struct<{', '.join(m.strip().replace(' ', ': ', 1) for m in measures.split(','))}>>"
    lines = spark.read.text(path)
    wrapped = F.from_json("value", f"per_ip {kind}")["per_ip"]
    return lines.select(F.explode(F.coalesce(wrapped, F.from_json("value", kind))).alias("src_ip", "m")).select("src_ip", "m.*")


def read_manifest(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Sessions of a ground-truth manifest, one row each, with their index; session gives their fields, else they are inferred."""
    reader = spark.read if session is None else spark.read.schema(f"sessions array<struct<{', '.join(_field(f) for f in _split(session))}>>")
    return reader.json(path, multiLine=True).select(F.posexplode("sessions").alias("session_index", "session")).select("session_index", "session.*")


def _split(fields: str) -> list[str]:
    """The fields of a schema text, at its outer commas."""
    return re.split(r",\s*(?![^<]*>)", fields)


def _field(field: str) -> str:
    return field.strip().replace(" ", ": ", 1)
