"""Commands applied to documents, each as a whole or not at all.

A command sees what the ones before it did, so a document's commands are folded in order; documents are independent and
are folded in parallel. Single-reference overlays that need no order are also given as joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FURNITURE = ("page_header", "page_footer")
KINDS = ("texts", "pictures", "tables", "groups")


class Refused(ValueError):
    """A command that the document doesn't allow."""


def _copied(x):
    """A copy of JSON; plain values can't change."""
    if isinstance(x, dict):
        return {k: v if isinstance(v, str) else _copied(v) for k, v in x.items()}
    if isinstance(x, list):
        return [v if isinstance(v, str) else _copied(v) for v in x]
    return x


class Draft(dict):
    """A document with an index of its nodes, and a journal of what a command has changed, so that it can be undone."""

    def __init__(self, doc: dict):
        super().__init__(doc)
        self.nodes = {}
        for kind in reversed(KINDS):
            for n in reversed(doc.get(kind, ())):
                self.nodes[n["self_ref"]] = n
        self.journal: list[Callable[[], None]] = []

    def keep(self, owner: dict, *keys: str) -> None:
        """Remembers entries of a node or container before they change; lists and boxes as copies."""
        for k in keys:
            if k in owner:
                old = _copied(owner[k])
                self.journal.append(lambda k=k, old=old: owner.__setitem__(k, old))
            else:
                self.journal.append(lambda k=k: owner.pop(k, None))

    def undo(self) -> None:
        while self.journal:
            self.journal.pop()()


def _node(doc: Draft, ref: str) -> dict:
    """The node that a command is about to change."""
    if (n := doc.nodes.get(ref)) is None:
        raise Refused(f"unknown reference {ref}")
    doc.keep(n, *(k for k in ("text", "orig", "label", "captions", "prov", "num_rows", "num_cols")))
    return n


def _containers(doc: dict) -> list[dict]:
    return [c for c in (doc.get("body"), doc.get("furniture"), *doc.get("groups", ())) if c]


def _unlink(doc: dict, ref: str) -> None:
    for c in _containers(doc):
        if ref in c.get("children", ()):
            doc.keep(c, "children")
            c["children"] = [x for x in c["children"] if x != ref]


def _insert(doc: dict, ref: str, beside: str, after: bool = True) -> None:
    for c in _containers(doc):
        if beside in c.get("children", []):
            doc.keep(c, "children")
            c["children"].insert(c["children"].index(beside) + after, ref)
            return
    raise Refused(f"{beside} stands in no container")


def _replace(doc: dict, ref: str, new: list[str]) -> None:
    for c in _containers(doc):
        if ref in c.get("children", []):
            doc.keep(c, "children")
            i = c["children"].index(ref)
            c["children"][i : i + 1] = new
            return
    raise Refused(f"{ref} stands in no container")


def _new(doc: dict, kind: str, **fields) -> dict:
    nodes = doc.setdefault(kind, [])
    node = {"self_ref": f"#/{kind}/{len(nodes)}", **fields}
    nodes.append(node)
    doc.nodes[node["self_ref"]] = node
    doc.journal.append(lambda: (nodes.pop(), doc.nodes.pop(node["self_ref"])))
    return node


def _home(doc: dict, label: str) -> list[str]:
    home = doc.setdefault("furniture" if label in FURNITURE else "body", {"children": []})
    doc.keep(home, "children")
    return home.setdefault("children", [])


def _caption(doc: dict, owner: dict, text: str) -> None:
    refs = owner.setdefault("captions", [])
    if refs:
        first = _node(doc, refs[0])
        first["text"] = first["orig"] = text
    else:
        refs.append(_new(doc, "texts", text=text, orig=text, label="caption", prov=_copied(owner.get("prov", [])))["self_ref"])


def replace_text(doc: dict, c: dict) -> None:
    n = _node(doc, c["textRef"])
    n["text"] = n["orig"] = c["text"]


def add_text(doc: dict, c: dict) -> None:
    n = _new(doc, "texts", text=c["text"], orig=c["text"], label=c["label"], prov=[{"page_no": c["pageNo"], "bbox": c["bbox"]}])
    if c.get("afterRef"):
        _insert(doc, n["self_ref"], c["afterRef"])
    else:
        _home(doc, c["label"]).append(n["self_ref"])


def update_text_role(doc: dict, c: dict) -> None:
    n = _node(doc, c["textRef"])
    moves = (n.get("label") in FURNITURE) != (c["label"] in FURNITURE)
    n["label"] = c["label"]
    if moves:
        _unlink(doc, c["textRef"])
        _home(doc, c["label"]).append(c["textRef"])


def remove_text(doc: dict, c: dict) -> None:
    _node(doc, c["textRef"])
    _unlink(doc, c["textRef"])
    for kind in ("pictures", "tables"):
        for n in doc.get(kind, ()):
            if c["textRef"] in n.get("captions", ()):
                doc.keep(n, "captions")
                n["captions"] = [r for r in n["captions"] if r != c["textRef"]]


def merge_texts(doc: dict, c: dict) -> None:
    if c["keepRef"] not in c["textRefs"]:
        raise Refused("the kept text isn't one of the merged")
    replace_text(doc, {"textRef": c["keepRef"], "text": c["text"]})
    for r in c["textRefs"]:
        if r != c["keepRef"]:
            remove_text(doc, {"textRef": r})


def split_text(doc: dict, c: dict) -> None:
    n, parts = _node(doc, c["textRef"]), c["parts"]
    if len(parts) < 2:
        raise Refused("a split needs two parts")
    n["text"] = n["orig"] = parts[0]["text"]
    n["label"] = parts[0].get("label") or n["label"]
    before = c["textRef"]
    for p in parts[1:]:
        made = _new(doc, "texts", text=p["text"], orig=p["text"], label=p.get("label") or n["label"], prov=_copied(n.get("prov", [])))
        _insert(doc, made["self_ref"], before)
        before = made["self_ref"]


def update_table_cell(doc: dict, c: dict) -> None:
    grid = _node(doc, c["tableRef"])["grid"]
    if not (0 <= c["row"] < len(grid) and 0 <= c["col"] < len(grid[c["row"]])):
        raise Refused("no such cell")
    cell = grid[c["row"]][c["col"]]
    doc.keep(cell, "text")
    cell["text"] = c["text"]


def replace_table(doc: dict, c: dict) -> None:
    n = _node(doc, c["tableRef"])
    old = n.get("grid")
    doc.journal.append(lambda: n.__setitem__("grid", old))
    n["grid"] = c["grid"]
    n["num_rows"], n["num_cols"] = len(c["grid"]), max((len(r) for r in c["grid"]), default=0)
    if c.get("caption"):
        _caption(doc, n, c["caption"])


def link_continued_table(doc: dict, c: dict) -> None:
    _node(doc, c["sourceTableRef"]), _node(doc, c["continuedTableRef"])
    doc.keep(doc, "links")
    doc.setdefault("links", []).append({"from": c["sourceTableRef"], "to": c["continuedTableRef"], "relation": c["relation"]})


def update_picture_caption(doc: dict, c: dict) -> None:
    _caption(doc, _node(doc, c["pictureRef"]), c["caption"])


def add_picture(doc: dict, c: dict) -> None:
    n = _new(doc, "pictures", captions=[], image={"uri": c["imageUri"]}, prov=[{"page_no": c["pageNo"], "bbox": c["bbox"]}])
    _home(doc, "picture").append(n["self_ref"])
    if c.get("caption"):
        _caption(doc, n, c["caption"])


def split_picture(doc: dict, c: dict) -> None:
    n = _node(doc, c["pictureRef"])
    if len(c["regions"]) < 2:
        raise Refused("a split needs two regions")
    page = n["prov"][0]["page_no"] if n.get("prov") else None
    made = []
    for i, r in enumerate(c["regions"]):
        p = _new(doc, "pictures", captions=list(n.get("captions", [])) if i == 0 else [], image={"uri": r.get("imageUri")}, prov=[{"page_no": page, "bbox": r["bbox"]}])
        if r.get("caption") and not p["captions"]:
            _caption(doc, p, r["caption"])
        made.append(p["self_ref"])
    _replace(doc, c["pictureRef"], made)


def hide_picture(doc: dict, c: dict) -> None:
    _node(doc, c["pictureRef"])
    _unlink(doc, c["pictureRef"])


def update_bbox(doc: dict, c: dict) -> None:
    n = _node(doc, c["targetRef"])
    if not n.get("prov"):
        raise Refused("nothing says where it stands")
    doc.evidence = {"previousBbox": n["prov"][0].get("bbox")}
    n["prov"][0]["bbox"] = c["bbox"]


def link_footnote(doc: dict, c: dict) -> None:
    _node(doc, c["markerTextRef"])
    update_text_role(doc, {"textRef": c["footnoteTextRef"], "label": "footnote"})
    doc.keep(doc, "links")
    doc.setdefault("links", []).append({"from": c["markerTextRef"], "to": c["footnoteTextRef"], "relation": "footnote"})


def move_node(doc: dict, c: dict) -> None:
    _node(doc, c["sourceRef"]), _node(doc, c["targetRef"])
    if c["sourceRef"] == c["targetRef"]:
        raise Refused("a node can't stand beside itself")
    _unlink(doc, c["sourceRef"])
    _insert(doc, c["sourceRef"], c["targetRef"], c["position"] == "after")


OPERATIONS: dict[str, Callable[[dict, dict], None]] = {
    "replaceText": replace_text, "addText": add_text, "updateTextRole": update_text_role, "removeText": remove_text, "mergeTexts": merge_texts, "splitText": split_text,
    "updateTableCell": update_table_cell, "replaceTable": replace_table, "linkContinuedTable": link_continued_table, "updatePictureCaption": update_picture_caption,
    "addPicture": add_picture, "splitPicture": split_picture, "hidePicture": hide_picture, "updateBbox": update_bbox, "linkFootnote": link_footnote, "moveNode": move_node,
}


def apply_commands(doc: dict, commands: list[dict]) -> tuple[dict, list[str]]:
    """The document after the commands, and for each ``applied``, with its evidence if it has any, or why it was skipped.

    A failing command leaves no trace: what it changed is undone, so the cost of a command is that of what it touches.
    """
    draft, done = Draft(_copied(doc)), []
    for c in commands:
        draft.journal, draft.evidence = [], None
        try:
            OPERATIONS[c["op"]](draft, c)
        except (Refused, KeyError, TypeError) as e:
            draft.undo()
            done.append(f"patch_skipped: {e}")
        else:
            done.append("applied" if draft.evidence is None else f"applied: {json.dumps(draft.evidence, sort_keys=True)}")
    return dict(draft), done


def patched(documents: DataFrame, commands: DataFrame, docs_a_group: int = 64) -> DataFrame:
    """(doc_id, document, outcomes): documents (doc_id, document: JSON) after their commands (doc_id, seq, command: JSON), some at a time."""
    both = documents.select("doc_id", F.lit(-1).cast("long").alias("seq"), F.col("document").alias("json")).unionAll(commands.select("doc_id", F.col("seq").cast("long"), F.col("command")))

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        of: dict[int, list] = {}
        for doc_id, seq, text in sorted(zip((None if d != d else d for d in p.doc_id.tolist()), p.seq.tolist(), p.json.tolist()), key=lambda r: r[:2]):
            of.setdefault(doc_id, []).append((seq, text))
        out = []
        for doc_id, rows in of.items():
            if rows[0][0] < 0:
                doc, done = apply_commands(json.loads(rows[0][1]), [json.loads(text) for seq, text in rows if seq >= 0])
                out.append((doc_id, json.dumps(doc, sort_keys=True, ensure_ascii=False), done))
        return pd.DataFrame(out, columns=["doc_id", "document", "outcomes"])

    return both.groupBy(F.floor(F.col("doc_id") / docs_a_group)).applyInPandas(fold, "doc_id long, document string, outcomes array<string>")


def replaced_texts(texts: DataFrame, corrections: DataFrame) -> DataFrame:
    """X1, X17 as a join: corrections (doc_id, self_ref, text) whose references are disjoint."""
    c = corrections.select("doc_id", "self_ref", F.col("text").alias("__new"))
    return texts.join(c, ["doc_id", "self_ref"], "left").withColumn("text", F.coalesce("__new", "text")).drop("__new")


def corrected_cells(cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """J17, X7 as a join on table, row and column."""
    c = corrections.select("table_id", "row", "col", F.col("text").alias("__new"))
    return cells.join(c, ["table_id", "row", "col"], "left").withColumn("text", F.coalesce("__new", "text")).drop("__new")


def without_removed(children: DataFrame, removed: DataFrame) -> DataFrame:
    """X4, X13 as a join: container rows (doc_id, child_ref) less the removed."""
    return children.join(removed.select("doc_id", F.col("self_ref").alias("child_ref")), ["doc_id", "child_ref"], "left_anti")
