"""All registered queries, in build order."""

from queries import base
from queries import rule_queries, cross_queries, posture_queries, session_queries, anomaly_queries, mart_queries, packet_queries, document_queries  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracles():
    return dict(base.ORACLES)
