"""Landed feeds: mail, documents and chat, as written by a connector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAIL = (
    "id string, account string, sender string, subject string, date string, "
    "received_at timestamp_ntz, snippet string, body string, thread_id string"
)
DOCUMENTS = (
    "id string, account string, name string, mime string, modified string, size bigint, "
    "text string, created_at timestamp_ntz"
)
CHAT = (
    "channel_id string, channel_name string, user_id string, user_name string, ts string, "
    "subtype string, text string"
)
SCHEMAS = {"mail": MAIL, "documents": DOCUMENTS, "chat": CHAT}


def read_feed(spark: SparkSession, kind: str, folder: str, form: str = "json") -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).format(form).load(folder)


def stream_feed(spark: SparkSession, kind: str, folder: str, form: str = "json") -> DataFrame:
    return spark.readStream.schema(SCHEMAS[kind]).format(form).load(folder)
