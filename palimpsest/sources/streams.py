"""Text streams as tables: mailboxes, raw diff records and lists of ids, from whole files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.codecs import mail_info, parse_raw_pairs, split_mbox


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): files as they are, one row each."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as text")


def mails(texts: DataFrame) -> DataFrame:
    """(path, n, name, email, subject, date, message, patch): the mails of (path, text) mailboxes, numbered from 1; a map, one mailbox in memory at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": path, "n": n, **mail_info(mail)} for path, text in frame.itertuples(index=False) for n, mail in enumerate(split_mbox(text or ""), 1)]
            yield pd.DataFrame(rows, columns=["path", "n", "name", "email", "subject", "date", "message", "patch"])

    return texts.select("path", "text").mapInPandas(run, "path string, n long, name string, email string, subject string, date string, message string, patch string")


def raw_pairs(texts: DataFrame) -> DataFrame:
    """(path, old_mode, new_mode, old_oid, new_oid, status, score, old_path, new_path): the records of (path, text) raw diffs."""
    names = ["old_mode", "new_mode", "old_oid", "new_oid", "status", "score", "old_path", "new_path"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": path, **pair} for path, text in frame.itertuples(index=False) for pair in parse_raw_pairs(text or "")]
            yield pd.DataFrame(rows, columns=["path", *names])

    return texts.select("path", "text").mapInPandas(run, "path string, old_mode long, new_mode long, old_oid string, new_oid string, status string, score long, old_path string, new_path string")
