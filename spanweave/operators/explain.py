"""Explanations of code by an injected client; offline a fixed fallback."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.scalars import cache_key

Client = Callable[[str], str]
FALLBACK = {"purpose": "Explanation unavailable.", "details": ""}
#: Answers where a part of the question is missing, and where there is none.
MISSING, NO_ANSWER = "Missing required parameters", "Could not generate an answer"
#: Seconds before each of the tries.
WAITS = (0.0, 0.7, 1.5)


class Busy(Exception):
    """Raised by a client that may be asked again."""


def parse_answer(raw: str) -> dict[str, str]:
    """The JSON object of an answer, code fences aside; other text is the purpose."""
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", raw)
    try:
        found = json.loads(bare)
    except ValueError:
        found = None
    return {k: str(found.get(k) or "") for k in FALLBACK} if isinstance(found, dict) else {"purpose": bare.strip(), "details": ""}


def explain(nodes: DataFrame, client: Client | None = None) -> DataFrame:
    """nodes(label, code) with purpose and details; each distinct label and code is asked once, after the dedup."""

    def ask(prompt: str) -> dict[str, str]:
        for wait in WAITS if client else ():
            time.sleep(wait)
            try:
                return parse_answer(client(prompt))
            except Busy:
                continue
            except Exception:
                break
        return FALLBACK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [ask(f"Explain {label}:\n{code}") for label, code in zip(b["label"], b["code"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "purpose": [x["purpose"] for x in said], "details": [x["details"] for x in said]})

    keyed = nodes.withColumn("key", cache_key(F.col("label"), F.col("code")))
    asked = keyed.where((F.length(F.trim("label")) > 0) & (F.length(F.trim("code")) > 0)).groupBy("key").agg(F.first("label").alias("label"), F.first("code").alias("code"))
    answers = asked.select("key", "label", "code").mapInPandas(run, "key string, purpose string, details string")
    return keyed.join(answers, "key", "left").drop("key")


def ask(questions: DataFrame, client: Client | None = None) -> DataFrame:
    """questions(label, code, question) with answer: the client's plain text, asked for once, without a second try, for each distinct question."""

    def said(prompt: str) -> str:
        try:
            return (client(prompt) if client else "") or NO_ANSWER
        except Exception:
            return NO_ANSWER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "answer": [said(f"{q}\n\n{label}:\n{code}") for label, code, q in zip(b["label"], b["code"], b["question"], strict=True)]})

    parts = ["label", "code", "question"]
    there = F.least(*[F.length(F.coalesce(c, F.lit(""))) for c in parts]) > 0
    keyed = questions.withColumn("key", F.when(there, cache_key(F.col("label"), F.col("code"), F.col("question"))))
    asked = keyed.where("key is not null").groupBy("key").agg(*[F.first(c).alias(c) for c in parts])
    return keyed.join(asked.mapInPandas(run, "key string, answer string"), "key", "left").withColumn("answer", F.coalesce("answer", F.lit(MISSING))).drop("key")
