"""Review of documents: schedule, command checks, dispositions, merge of decisions, conflicts, arbitration, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed

REFS_A_ITEM = 4


def _lookup(key: Column, pairs: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def allowed(commands: DataFrame) -> DataFrame:
    """Commands whose operation belongs to their task."""
    ok = F.lit(False)
    for task, ops in fixed.TASK_OPS.items():
        ok = ok | ((F.col("task") == task) & F.col("op").isin(*ops))
    return commands.where(ok)


def pending(items: DataFrame, completed: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed items aren't tried again, either."""
    return items.join(completed, "item_id", "left_anti").join(failed, "item_id", "left_anti")


def work_items(candidates: DataFrame, size: int = REFS_A_ITEM) -> DataFrame:
    """References of a page and kind in groups of ``size``, with ids and the kinds' priorities (lower first)."""
    from docloom.functions.text import work_item_id

    place = F.row_number().over(Window.partitionBy("page", "kind").orderBy("ord")) - 1
    groups = candidates.withColumn("chunk", F.floor(place / size).cast("long")).groupBy("page", "kind", "priority", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x["ref"]).alias("refs"))
    return groups.withColumn("item_id", work_item_id(F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(":"), F.col("kind")), F.col("refs")))


def touched_once(commands: DataFrame) -> DataFrame:
    """V5: of otherwise valid commands on one reference of a page the first stays valid."""
    first = F.row_number().over(Window.partitionBy("page", "target", "valid").orderBy("seq")) == 1
    again = F.col("valid") & ~first
    return commands.select(*(c for c in commands.columns if c != "valid"), (F.col("valid") & first).alias("valid"), F.when(again, "target_already_touched").alias("touch_reason"))


def dispositions(commands: DataFrame, allow_auto: bool = True, force: bool = False, auto_from: float = fixed.AUTO_FROM, proposal_from: float = fixed.PROPOSAL_FROM) -> DataFrame:
    """V6, V7: final confidence, and whether a command is applied, proposed or skipped, with the reason it isn't applied.

    Expects op, confidence, valid, trusted (misread ideographs, text within pictures), evidenced (the operation's candidate exists).
    """
    penalty = F.when(F.col("trusted") & (F.col("op") == "removeText"), 0.0).otherwise(F.coalesce(_lookup(F.col("op"), fixed.RISK_PENALTIES), F.lit(0.0)))
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") - penalty))
    block = F.when(F.col("op").isin(*fixed.EVIDENCED_OPS) & F.col("evidenced"), None).otherwise(_lookup(F.col("op"), fixed.BLOCK_REASONS))
    c = commands.withColumn("final", F.round(final, 9)).withColumn("block", block).withColumn("needed", F.when(F.col("trusted"), F.lit(min(auto_from, fixed.TRUSTED_AUTO_FROM))).otherwise(F.lit(auto_from)))
    auto = F.lit(allow_auto) & (F.lit(force) | ((F.col("final") >= F.col("needed")) & F.col("block").isNull()))
    verdict = F.when(~F.col("valid") | (F.col("final") < proposal_from), "skipped").when(auto, "auto_applied").otherwise("proposal")
    why = F.when(F.lit(not allow_auto), "auto_apply_disabled").when(F.col("final") < F.col("needed"), "below_auto_apply_threshold").otherwise(F.col("block"))
    return c.withColumn("disposition", verdict).withColumn("reason", F.when(F.col("disposition") == "proposal", why)).drop("block", "needed")


def deduplicated(decisions: DataFrame) -> DataFrame:
    """Of decisions with one signature the most confident stays, the earlier of equal ones, with the reasons of all."""
    best = decisions.groupBy("page", "signature").agg(F.max_by(F.struct(*(c for c in decisions.columns if c not in ("page", "signature", "reasons"))), F.struct("confidence", -F.col("seq"))).alias("d"),
                                                      F.array_sort(F.collect_list(F.struct("seq", "reasons"))).alias("all"))
    return best.select("page", "signature", "d.*", F.array_distinct(F.flatten(F.transform("all", lambda x: x["reasons"]))).alias("reasons"))


def conflicts(touches: DataFrame) -> DataFrame:
    """(page, id, other) for decisions on one reference: each later one conflicts with the reference's first holder."""
    first = F.first_value("id").over(Window.partitionBy("page", "ref").orderBy("seq"))
    return touches.withColumn("other", first).where("id <> other").select("page", "id", "other").distinct()


def conflict_groups(edges: DataFrame, pages_a_group: int = 64) -> DataFrame:
    """(page, id, root) of decisions joined by conflicts; a page's few decisions are united in one task, some pages at a time."""
    import pandas as pd

    def unite(p: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for page, a, b in zip(p.page.tolist(), p.id.tolist(), p.other.tolist()):
            a, b = find((page, a)), find((page, b))
            root[max(a, b)] = min(a, b)
        return pd.DataFrame([(page, i, find((page, i))[1]) for page, i in sorted(root)], columns=["page", "id", "root"])

    return edges.groupBy(F.floor(F.col("page") / pages_a_group)).applyInPandas(unite, "page long, id long, root long")


def arbitrated(decisions: DataFrame, groups: DataFrame, gap: float = 0.3) -> DataFrame:
    """Conflicting decisions become proposals; where the best of a group leads by more than ``gap`` it stands and the others go."""
    g = groups.join(decisions.select("page", "id", "confidence", "seq"), ["page", "id"])
    order = Window.partitionBy("page", "root").orderBy(F.desc("confidence"), "seq")
    ranked = g.withColumn("n", F.row_number().over(order)).withColumn("second", F.max(F.when(F.col("n") == 2, F.col("confidence"))).over(Window.partitionBy("page", "root")))
    lead = F.max(F.when(F.col("n") == 1, F.col("confidence"))).over(Window.partitionBy("page", "root")) - F.col("second")
    ruled = ranked.withColumn("clear", F.round(lead, 9) > gap).select("page", "id", "n", "clear")
    out = decisions.join(ruled, ["page", "id"], "left")
    kept = out.where(~F.coalesce((F.col("n") > 1) & F.col("clear"), F.lit(False)))
    demoted = F.col("n").isNotNull() & ~F.coalesce("clear", F.lit(False)) & (F.col("disposition") == "auto_applied")
    return kept.withColumn("disposition", F.when(demoted, "proposal").otherwise(F.col("disposition"))).drop("n", "clear")


def overlaid(decisions: DataFrame, patches: DataFrame, dropped: DataFrame) -> DataFrame:
    """Patched decisions in place of their originals, dropped ones gone."""
    p = patches.select("id", F.col("disposition").alias("__new"))
    return decisions.join(dropped, "id", "left_anti").join(p, "id", "left").withColumn("disposition", F.coalesce("__new", "disposition")).drop("__new")


def report(decisions: DataFrame) -> DataFrame:
    """Counts a page and overall (page null)."""
    c = [F.count_if(F.col("disposition") == d).alias(d) for d in ("auto_applied", "proposal", "skipped")]
    return decisions.rollup("page").agg(F.count("*").alias("decisions"), *c, F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def failed_pages(items: DataFrame) -> DataFrame:
    """Pages all of whose work items failed."""
    return items.groupBy("page").agg(F.bool_and("failed").alias("failed")).where("failed").select("page")


def gated(pages: DataFrame) -> DataFrame:
    """A page is reviewed if its gate says so, is missing or failed, and its image is there."""
    return pages.withColumn("eligible", F.coalesce("gate", F.lit(True)) & F.col("has_image"))


def suspect_reasons(texts: DataFrame) -> DataFrame:
    """Why a text block is looked at: empty, noise, repeated on other pages, likely misread, caption by its wording only."""
    from docloom.functions import text as T

    t = F.col("text")
    same = Window.partitionBy("doc_id", "__n")
    j = texts.withColumn("__n", T.spaceless(t)).withColumn("__again", (F.length("__n") >= 2) & (F.min("page_no").over(same) != F.max("page_no").over(same)))
    rules = {
        "empty_text": T.collapsed(t) == "", "ocr_noise": T.is_ocr_noise(t), "repeated_across_pages": F.coalesce("__again", F.lit(False)),
        "hanja_ocr_candidate": F.size(T.hanja_candidates(t)) > 0, "caption_like_body_text": T.looks_like_caption(t) & (F.col("label") == "text"),
        "footnote_like_body_text": T.looks_like_footnote(t) & (F.col("label") == "text"),
    }
    reasons = F.filter(F.array(*(F.when(r, F.lit(n)) for n, r in rules.items())), lambda x: x.isNotNull())
    return j.withColumn("reasons", reasons).drop("__n", "__again")
