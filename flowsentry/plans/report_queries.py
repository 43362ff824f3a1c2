"""Queries of the review reports, with SQL written out by hand over the shared events."""

from __future__ import annotations

from flowsentry.functions.expressions import CLASSES
from flowsentry.operators import reports
from flowsentry.plans import oracle as o
from flowsentry.plans.queries import _FAMILY, _REASONS, events_of, query, risk_of

_LEADING = "(SELECT coalesce(string_agg(concat({name}, ':', n), ',' ORDER BY n DESC, {name}), '') FROM (SELECT {name}, n FROM {table} t WHERE t.{key} = {outer} ORDER BY n DESC, {name} LIMIT {top}) z)"


@query(f"""WITH {o.EVENTS}, reasons AS ({_REASONS}), fam AS (SELECT src_ip, k, bool_or({_FAMILY} = 'anomaly') AS by_model FROM reasons GROUP BY 1, 2),
h AS (SELECT e.attack_type, count(*) AS n FROM events_ e JOIN fam f ON f.src_ip = e.src_ip AND f.k = e.k WHERE e.anomaly_score = 0 AND NOT f.by_model GROUP BY 1),
s AS (SELECT attack_type, src_ip, count(*) AS n FROM events_ GROUP BY 1, 2), rs AS (SELECT attack_type, reason, count(*) AS n FROM reasons GROUP BY 1, 2)
SELECT c.attack_type, count(e.k) AS n, floor(count(e.k) * 1e2 / (SELECT count(*) FROM events_) * 1e4 + 0.5) / 1e4 AS percent,
  min(confidence) AS min_confidence, max(confidence) AS max_confidence, min(risk_score) AS min_risk_score, max(risk_score) AS max_risk_score, min(anomaly_score) AS min_anomaly_score, max(anomaly_score) AS max_anomaly_score,
  floor(quantile_cont(confidence, 0.5) * 1e4 + 0.5) / 1e4 AS median_confidence, floor(quantile_cont(risk_score, 0.5) * 1e4 + 0.5) / 1e4 AS median_risk_score, floor(quantile_cont(anomaly_score, 0.5) * 1e4 + 0.5) / 1e4 AS median_anomaly_score,
  count(CASE WHEN anomaly_score = 0 THEN 1 END) AS zero_anomaly, coalesce((SELECT h.n FROM h WHERE h.attack_type = c.attack_type), 0) AS heuristic_only,
  {_LEADING.format(name='src_ip', table='s', key='attack_type', outer='c.attack_type', top=3)} AS top_sources, {_LEADING.format(name='reason', table='rs', key='attack_type', outer='c.attack_type', top=3)} AS top_reasons
FROM (VALUES {', '.join(f"('{c}')" for c in CLASSES)}) c(attack_type) LEFT JOIN events_ e ON e.attack_type = c.attack_type GROUP BY 1""")
def accuracy_class_report(spark, d):
    return reports.class_report(events_of(spark, d))


@query(f"""WITH {o.EVENTS}, ev AS (SELECT *, ts_us // 86400000000 AS day FROM events_), s AS (SELECT day, src_ip, count(*) AS n FROM ev GROUP BY 1, 2), days AS (SELECT ts_us // 86400000000 AS day, count(*) AS rows FROM risk GROUP BY 1)
SELECT day, rows, (SELECT count(*) FROM ev WHERE ev.day = days.day) AS suspicious,
  (SELECT concat(src_ip, ',', k, ',', attack_type) FROM ev WHERE ev.day = days.day ORDER BY confidence DESC, risk_score DESC, ts_us DESC, src_ip DESC, k DESC LIMIT 1) AS most_confident,
  (SELECT concat(src_ip, ',', k, ',', attack_type) FROM ev WHERE ev.day = days.day ORDER BY risk_score DESC, confidence DESC, ts_us DESC, src_ip DESC, k DESC LIMIT 1) AS riskiest,
  {_LEADING.format(name='src_ip', table='s', key='day', outer='days.day', top=5)} AS top_sources FROM days""")
def classify_day_report(spark, d):
    return reports.day_report(risk_of(spark, d), events_of(spark, d))
