"""A review from work items to ruled decisions, in rounds.

Each round asks the provider for commands of the items still open, validates them item by item and writes what came out: items
without a mendable fault are done, the others go into the next round with their faults as feedback, until none is left or the
attempts are used up; those fail, and their decisions are dropped. A round's input is what the last one wrote, so a lost
executor costs a round, and every round's table can be read afterwards. A page fails if all of its items do. Decisions are then
deduplicated by signature, ruled on, grouped where they claim one reference, and arbitrated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators import commands, context, review
from docloom.sources.shared import written

ITEM = ("doc_id", "page", "item")
#: A page's place among all documents' pages.
PAGES = 1 << 24


@dataclass
class Review:
    """``items``: doc_id, page, item, attempts, status, feedback; ``decisions`` of the items that weren't lost; ``rounds`` as written."""

    items: DataFrame
    decisions: DataFrame
    rounds: list[DataFrame]


def with_task_reasons(ruled: DataFrame) -> DataFrame:
    """Commands of operations that their item's task (in ``tasks``, by item) doesn't hold get a reason for it and are invalid."""
    ops = F.create_map(*(x for task, ops in fixed.TASK_OPS.items() for x in (F.lit(task), F.array(*map(F.lit, ops)))))
    task = F.try_element_at("tasks", F.col("item"))
    strange = task.isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(ops, task), F.col("op")), F.lit(False))
    why = F.concat("reasons", F.when(strange, F.array(F.concat(F.lit("task_op_not_allowed:"), "op"))).otherwise(F.array().cast("array<string>")))
    return ruled.withColumn("reasons", why).withColumn("valid", F.col("valid") & ~strange).drop("tasks")


def run(items: DataFrame, provider: Callable[[DataFrame, int], DataFrame], contexts: DataFrame, attempts: int = 3) -> Review:
    """Reviews ``items`` (doc_id, page, item, task) with what ``provider(open items with their feedback, attempt)`` answers."""
    opened = items.select(*ITEM, "task", F.array().cast("array<string>").alias("feedback"))
    rounds, done, decisions = [], [], []
    attempts = max(1, attempts)
    contexts = written(contexts, "review-contexts")
    for attempt in range(1, attempts + 1):
        tasks = opened.groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("item", "task"))).alias("tasks"))
        answers = commands.validated(provider(opened, attempt), contexts, ("item",), tasks)
        ruled = written(with_task_reasons(answers).withColumn("asked", context.asked_again(F.col("reasons"))), f"review-commands-{attempt}")
        in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "asked"))), lambda x: x["asked"]))
        faults = ruled.where(F.size("asked") > 0).groupBy(*ITEM).agg(F.array_distinct(in_order).alias("faults"))
        result = opened.join(faults, list(ITEM), "left").select(
            *ITEM, "task", F.lit(attempt).alias("attempts"), F.coalesce("faults", "feedback").alias("feedback"),
            F.when(F.col("faults").isNull(), "passed" if attempt == 1 else "reasked").when(F.lit(attempt == attempts), "failed").otherwise("open").alias("status"),
        )
        rounds.append(written(result, f"review-round-{attempt}"))
        ended = rounds[-1].where("status <> 'open'")
        done.append(ended.select(*ITEM, "attempts", "status", "feedback"))
        decisions.append(ruled.join(ended.where("status <> 'failed'").select(*ITEM), list(ITEM), "left_semi"))
        opened = rounds[-1].where("status = 'open'").select(*ITEM, "task", "feedback")
        if opened.isEmpty():
            break
    all_of = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(all_of(parts[1:]))
    return Review(all_of(done), all_of(decisions), rounds)


def lost_pages(items: DataFrame) -> DataFrame:
    """Pages all of whose items failed."""
    return items.groupBy("doc_id", "page").agg(F.bool_and(F.col("status") == "failed").alias("lost")).where("lost").select("doc_id", "page")


def ruled_on(decisions: DataFrame, **options) -> DataFrame:
    """Decisions (with a ``signature``) deduplicated, disposed of and arbitrated; of one page ``seq`` tells them apart."""
    key = (F.col("doc_id") * PAGES + F.col("page")).alias("page")
    d = review.dispositions(decisions.select("doc_id", F.col("page").alias("page_no"), key, F.col("seq").alias("id"), "seq", "signature", "op", "ref", "other_ref", "confidence", "valid", "trusted", "evidenced", "reasons"), **options)
    d = written(review.deduplicated(d.withColumn("confidence", F.col("final")).drop("final")), "review-decisions")
    refs = F.when(F.col("op").isin("addText", "addPicture"), F.array().cast("array<string>")).when(F.col("op") == "linkFootnote", F.array("ref", "other_ref")).otherwise(F.array("ref"))
    touches = d.where("disposition <> 'skipped'").select("page", "id", "seq", F.explode(refs).alias("ref"))
    return review.arbitrated(d, review.conflict_groups(review.conflicts(touches)))
