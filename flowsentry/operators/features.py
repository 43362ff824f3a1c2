"""Features of single connections, DNS queries and TLS sessions; cleaning and time slices of flows."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.expressions import is_noise

#: Connection features over flows; ratios use the unfilled values, so a null stays null.
CONNECTION = {
    "bytes_ratio": "resp_bytes * 1e0 / (orig_bytes + 1)",
    "proto_tcp": "CASE WHEN proto = 'tcp' THEN 1 ELSE 0 END",
    "proto_udp": "CASE WHEN proto = 'udp' THEN 1 ELSE 0 END",
    "proto_icmp": "CASE WHEN proto = 'icmp' THEN 1 ELSE 0 END",
    **{f"conn_state_{s}": f"CASE WHEN conn_state = '{s}' THEN 1 ELSE 0 END" for s in ("S0", "SF", "REJ", "OTH")},
    "is_well_known_port": "CASE WHEN coalesce(dst_port, 0) < 1024 THEN 1 ELSE 0 END",
    **{f"is_{n}": f"CASE WHEN dst_port = {p} THEN 1 ELSE 0 END" for n, p in (("http", 80), ("https", 443), ("dns", 53), ("ssh", 22))},
    "is_external": "CASE WHEN dst_ip LIKE '192.168.%' THEN 0 ELSE 1 END",
    "day_of_week": "(CAST(floor(ts_us / 86400000000) AS BIGINT) + 3) % 7",
    "hour_of_day": "CAST(floor(ts_us / 3600000000) AS BIGINT) % 24",
    "is_night": "CASE WHEN CAST(floor(ts_us / 3600000000) AS BIGINT) % 24 < 6 THEN 1 ELSE 0 END",
}


#: Features of the packet columns that connection logs have besides.
PACKETS = {
    "pkts_ratio": "resp_pkts * 1e0 / (orig_pkts + 1)",
    "avg_orig_pkt_size": "orig_bytes * 1e0 / (orig_pkts + 1)",
    "avg_resp_pkt_size": "resp_bytes * 1e0 / (resp_pkts + 1)",
}
#: Measures that are themselves features, absent ones as 0.
MEASURES = ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "missed_bytes")


def connection_features(flows: DataFrame) -> DataFrame:
    """flows with the features of their connections (Monday is day 0); those of packets if flows have packet columns."""
    packets = PACKETS if {"orig_pkts", "resp_pkts"} <= set(flows.columns) else {}
    return flows.selectExpr("*", *[f"{e} AS {c}" for c, e in (CONNECTION | packets).items()])


def connection_vector(flows: DataFrame) -> DataFrame:
    """All features of connection logs: measures (null as 0), ratios of the unfilled measures, kinds, ports and time."""
    found = connection_features(flows)
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (*MEASURES, "dst_port")]
    return found.select("ts_us", "src_ip", "dst_ip", *filled, *[c for c in found.columns if c in CONNECTION or c in PACKETS], *[c for c in ("event_id",) if c in found.columns])


def dns_features(log: DataFrame) -> DataFrame:
    """Features of parsed DNS log rows."""
    query = F.coalesce("query", F.lit(""))
    types = [F.coalesce((F.col("qtype_name") == t).cast("int"), F.lit(0)).alias(f"qtype_{t}") for t in ("A", "AAAA", "MX", "TXT")]
    return log.select("*", *types, F.coalesce((F.col("rcode_name") == "NOERROR").cast("int"), F.lit(0)).alias("dns_success"), F.coalesce((F.col("rejected") == "T").cast("int"), F.lit(0)).alias("dns_rejected"), F.length(query).alias("query_length"), (F.length(query) - F.length(F.replace(query, F.lit("."), F.lit("")))).alias("query_dots"), F.coalesce(F.col("rtt").try_cast("double"), F.lit(0.0)).alias("dns_rtt"))


def ssl_features(log: DataFrame) -> DataFrame:
    """Features of parsed TLS log rows; a null version is not an old one."""
    one = lambda c, v: F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
    old = F.when(F.col("version").isNotNull() & ~F.col("version").isin("TLSv13", "TLSv12"), 1).otherwise(0)
    return log.select("*", one("version", "TLSv13").alias("tls_13"), one("version", "TLSv12").alias("tls_12"), old.alias("tls_old"), one("established", "T").alias("ssl_established"), one("resumed", "T").alias("ssl_resumed"), one("sni_matches", "T").alias("sni_match"), one("validation_status", "ok").alias("valid_chain"), F.length(F.coalesce("server_name", F.lit(""))).alias("sni_length"))


def without_noise(flows: DataFrame) -> DataFrame:
    return flows.filter(f"NOT {is_noise()}")


def without_noise_of(flows: DataFrame, networks: list[str]) -> DataFrame:
    """without_noise, with destinations trimmed, and also without the broadcast addresses of these networks (IPv6 ones have none)."""
    known = [ipaddress.ip_network(n, strict=False) for n in networks]
    addresses = [str(n.broadcast_address) for n in known if n.version == 4]
    trimmed = flows.withColumn("dst_ip", F.trim("dst_ip"))
    return without_noise(trimmed.filter(~F.coalesce("dst_ip", F.lit("")).isin(*addresses)) if addresses else trimmed)


def collected(flows: DataFrame, stored: DataFrame) -> DataFrame:
    """New flows since the stored ones' last time, without noise and exact repeats."""
    mark = stored.agg(F.max("ts_us").alias("mark"))
    new = flows.crossJoin(F.broadcast(mark)).filter("ts_us > coalesce(mark, -1)").drop("mark")
    return without_noise(new).dropDuplicates()


def cleaned(flows: DataFrame) -> DataFrame:
    """One flow for each (time, source, destination, port), the first arrival; rows without a time go."""
    first = Window.partitionBy("ts_us", "src_ip", "dst_ip", "dst_port").orderBy("event_id")
    return flows.filter("ts_us IS NOT NULL").withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank")


def local_sources(flows: DataFrame) -> DataFrame:
    return flows.filter("src_ip LIKE '192.168.%'").select("src_ip").distinct()


def in_networks(address: str, networks: list[str]):
    """Whether an IPv4 address column lies in any of the networks; what is no address is in none."""
    import ipaddress

    valid = F.col(address).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    n = F.lit(0).cast("long")
    for i in range(4):
        n = n * 256 + F.get(F.split(F.col(address), r"\."), F.lit(i)).try_cast("long")
    found = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        found = found | n.between(int(net.network_address), int(net.broadcast_address))
    return valid & F.coalesce(found, F.lit(False))


def between(flows: DataFrame, start_us: int, end_us: int, src_ip: str | None = None, dst_ip: str | None = None) -> DataFrame:
    """Flows of a time slice, both ends included, and of one source or destination."""
    rows = flows.filter(F.col("ts_us").between(start_us, end_us))
    for c, v in (("src_ip", src_ip), ("dst_ip", dst_ip)):
        rows = rows.filter(F.col(c) == v) if v else rows
    return rows
