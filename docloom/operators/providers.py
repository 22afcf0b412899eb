"""Model calls behind an interface. Rule-based and replaying providers run offline; a networked one is injected.

A provider is a picklable object with ``name`` and ``call(requests) -> list[dict | None]``; it is called with a batch of
requests on an executor, and what it raises counts as no answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "request_id long, response string, model string, attempts int, error string"


class Provider(Protocol):
    name: str

    def call(self, requests: list[dict]) -> list[dict | None]: ...


@dataclass
class Rules:
    """Answers by a function of the request: deterministic, offline."""

    rule: Callable[[dict], dict | None]
    name: str = "rules"

    def call(self, requests: list[dict]) -> list[dict | None]:
        return [self.rule(r) for r in requests]


@dataclass
class Replay:
    """Recorded answers by request key; what was not recorded has none."""

    recorded: dict[str, dict] = field(default_factory=dict)
    name: str = "replay"

    def call(self, requests: list[dict]) -> list[dict | None]:
        return [self.recorded.get(r.get("key", "")) for r in requests]


def answer(requests: list[dict], primary: Provider, fallback: Provider | None, valid: Callable[[dict], bool], retries: int) -> list[tuple[dict | None, str | None, int, str | None]]:
    """Each request is tried on the primary, up to ``retries`` times again, then on the fallback."""
    out: list[tuple] = [(None, None, 0, "no answer")] * len(requests)
    left = list(range(len(requests)))
    for provider in filter(None, (primary, fallback)):
        for _ in range(1 + retries):
            if not left:
                return out
            try:
                got = provider.call([requests[i] for i in left])
                error = "no answer"
            except Exception as e:  # noqa: BLE001 a provider's failure is a result
                got, error = [None] * len(left), str(e)
            rest = []
            for i, a in zip(left, got):
                tries = out[i][2] + 1
                if a is not None and valid(a):
                    out[i] = (a, provider.name, tries, None)
                else:
                    out[i] = (None, None, tries, error if a is None else "invalid answer")
                    rest.append(i)
            left = rest
    return out


def called(requests: DataFrame, primary: Provider, fallback: Provider | None = None, valid: Callable[[dict], bool] = lambda a: True, retries: int = 2) -> DataFrame:
    """Requests (request_id, request: JSON) with their answers; concurrency is the number of partitions."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            got = answer([json.loads(x) for x in b.request], primary, fallback, valid, retries)
            yield pd.DataFrame({
                "request_id": b.request_id.to_numpy(), "response": [None if a is None else json.dumps(a, ensure_ascii=False, sort_keys=True) for a, *_ in got],
                "model": [m for _, m, _, _ in got], "attempts": [n for _, _, n, _ in got], "error": [e for *_, e in got],
            })

    return requests.select("request_id", "request").mapInPandas(batches, RESULT)


_CAPTION = re.compile(r"^\s*[\[(<〈【]?\s*((?:[A-Za-z]+\.?|[가-힣]+|[圖図表])\s*\d+(?:[-–.]\d+)*)")


def caption_rule(request: dict) -> dict:
    """The number of a caption by its prefix."""
    m = _CAPTION.match(request.get("text") or "")
    return {"num": m[1] if m else None}


def page_number_rule(request: dict) -> dict:
    """U8: the number in a page's first or last line, if it stands there alone."""
    lines = [x.strip() for x in (request.get("text") or "").split("\n") if x.strip()]
    for line in (lines[-1:] + lines[:1]):
        if m := re.fullmatch(r"[-–—\s]*(\d{1,4})[-–—\s]*", line):
            return {"start": int(m[1]), "end": int(m[1])}
    return {"start": None, "end": None}


def correction_rows(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """A page's prompt rows: ``i|code|text`` of texts, then ``row,col|text`` of its non-empty cells."""
    code = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in {"text": "tx", "section_header": "sh", "list_item": "li", "footnote": "fn", "caption": "ca", "page_header": "ph", "page_footer": "pf"}.items() for x in kv)), F.col("label")), F.lit("tx"))
    t = texts.select("page", F.lit(0).alias("part"), "n", F.concat_ws("|", F.col("n").cast("string"), code, "text").alias("line"))
    c = cells.where("trim(text) <> ''").select("page", F.lit(1).alias("part"), (F.col("row") * 10000 + F.col("col")).alias("n"), F.concat(F.col("row").cast("string"), F.lit(","), F.col("col").cast("string"), F.lit("|"), "text").alias("line"))
    both = t.unionByName(c).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("part", "n", "line"))).alias("x"))
    return both.select("page", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("prompt"))


def batched(df: DataFrame, size: int, order: str) -> DataFrame:
    """Rows in groups of ``size`` a document."""
    from pyspark.sql import Window

    if size <= 0:
        raise ValueError("a batch needs a positive size")
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1) / size))
