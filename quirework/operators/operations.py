"""Batches of operations on the frames and outline of a book, replayed in order by one group for each book."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirework.functions.grouped import gathered, whole_runs
from quirework.session import bound_batches

LEAST = 0.01  # height of a part
STATE = "book_id string, ok boolean, applied int, error string, frames string, outline string, seq long, meta string"


class Refused(ValueError):
    """An operation that can't be done; its whole batch is undone."""


def _regions(value: list | None) -> list[dict]:
    return [_region(r) for r in value or []]


def _rect(r: dict) -> dict:
    out = {k: float(r[k]) for k in ("left", "top", "right", "bottom")}
    if min(out.values()) < -0.01 or max(out.values()) > 1.01:
        raise Refused("rect beyond the page")
    out = {k: min(1.0, max(0.0, v)) for k, v in out.items()}
    if out["left"] >= out["right"] or out["top"] >= out["bottom"]:
        raise Refused("rect inverted")
    return out


def _region(r: dict) -> dict:
    return {"page": int(r["page"]), "rect": _rect(r["rect"])}


class Book:
    """Frames by id and an outline in preorder."""

    def __init__(self, frames: list[dict], outline: list[dict], seq: int = 0, meta: dict | None = None):
        self.frames = {f["id"]: f for f in frames}
        self.outline, self.meta = list(outline), dict(meta or {})
        known = [int(i[1:]) for f in frames for i in (f["id"], f.get("unit") or "") if i[:1] in "fu" and i[1:].isdigit()]
        self.seq = max([seq, *known])

    # -- lookups

    def new_id(self, letter: str) -> str:
        self.seq += 1
        return f"{letter}{self.seq}"

    def find(self, op: dict) -> dict:
        if op.get("id") is not None:
            found = self.frames.get(op["id"])
        else:
            found = next((f for f in self.frames.values() if f.get("authority") and f.get("section") == op.get("section") and f.get("label") == op.get("label")), None)
        if not found:
            raise Refused("no such frame")
        return found

    def parts(self, frame: dict) -> list[dict]:
        if not frame.get("unit"):
            return [frame]
        return sorted((f for f in self.frames.values() if f.get("unit") == frame["unit"]), key=lambda f: (f["page"], f["rect"]["top"], f["rect"]["left"], f["id"]))

    def entry(self, op: dict) -> int:
        for i, e in enumerate(self.outline):
            if ("index" in op and i == op["index"]) or ("section" in op and e.get("id") == op["section"]):
                return i
        raise Refused("no such outline entry")

    def used(self, section: str | None) -> bool:
        return section is not None and any(f.get("section") == section for f in self.frames.values())

    # -- frames

    def add(self, op: dict) -> str:
        frame = {"id": op.get("id"), "kind": op.get("kind", "exercise"), "page": int(op["page"]), "rect": _rect(op["rect"]), "unit": None, "continues": _regions(op.get("continues")), "context": _regions(op.get("context")), "solution": _regions(op.get("solution")), "authority": op.get("authority"), "label": op.get("label"), "section": op.get("section")}
        if frame["authority"]:
            same = next((f for f in self.frames.values() if f.get("authority") and (f.get("section"), f.get("label")) == (frame["section"], frame["label"])), None)
            if same:
                if not op.get("replace"):
                    raise Refused("exercise exists")
                same |= {"page": frame["page"], "rect": frame["rect"], "continues": frame["continues"]} | {k: frame[k] for k in ("context", "solution") if k in op}
                return same["id"]
        if frame["id"] in self.frames:
            raise Refused("id exists")
        frame["id"] = frame["id"] or self.new_id("f")
        self.frames[frame["id"]] = frame
        return frame["id"]

    def update(self, op: dict) -> None:
        f = self.find(op)
        if f.get("unit") and ("page" in op or "rect" in op):
            raise Refused("geometry of a unit's part")
        f |= {k: op[k] for k in ("kind", "page") if k in op} | ({"rect": _rect(op["rect"])} if "rect" in op else {})
        if f["kind"] != "exercise":
            f |= {"context": [], "solution": []}

    def delete(self, op: dict) -> None:
        f = self.find(op)
        parts = self.parts(f)
        at = parts.index(f)
        if op.get("unit") and f.get("unit"):
            for p in parts:
                del self.frames[p["id"]]
            return
        if f.get("unit"):
            rest = [p for p in parts if p is not f]
            if 0 < at < len(parts) - 1:
                parts[at - 1]["rect"] = parts[at - 1]["rect"] | {"bottom": f["rect"]["bottom"]}
            if f.get("context") and rest:
                rest[0]["context"] = rest[0].get("context") or f["context"]
            if len(rest) == 1:
                rest[0]["unit"] = None
        del self.frames[f["id"]]

    def move(self, op: dict) -> None:
        f = self.find(op)
        group = [p for p in self.parts(f) if p["page"] == f["page"]]
        dx = min(max(float(op.get("dx", 0)), -min(p["rect"]["left"] for p in group)), 1 - max(p["rect"]["right"] for p in group))
        dy = min(max(float(op.get("dy", 0)), -min(p["rect"]["top"] for p in group)), 1 - max(p["rect"]["bottom"] for p in group))
        for p in group:
            r = p["rect"]
            p["rect"] = {"left": r["left"] + dx, "right": r["right"] + dx, "top": r["top"] + dy, "bottom": r["bottom"] + dy}

    def divide(self, f: dict, cuts: list[float]) -> None:
        parts = self.parts(f)
        if len({p["page"] for p in parts}) > 1 or f.get("authority") or f["kind"] != "exercise":
            raise Refused("can't be divided")
        top, bottom = parts[0]["rect"]["top"], parts[-1]["rect"]["bottom"]
        edges = [top, *sorted(cuts), bottom]
        if any(b - a < LEAST for a, b in zip(edges, edges[1:], strict=False)):
            raise Refused("part too flat")
        unit = f.get("unit") or (self.new_id("u") if len(edges) > 2 else None)
        base = parts[0]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            p = parts[i] if i < len(parts) else {"id": self.new_id("f"), "kind": "exercise", "page": base["page"], "continues": [], "context": [], "solution": [], "authority": None, "label": None, "section": None}
            p |= {"unit": unit if len(edges) > 2 else None, "rect": base["rect"] | {"top": a, "bottom": b}}
            self.frames[p["id"]] = p
        for p in parts[len(edges) - 1 :]:
            del self.frames[p["id"]]

    def split(self, op: dict) -> None:
        f = self.find(op)
        parts = self.parts(f)
        self.divide(f, [p["rect"]["top"] for p in parts[1:]] + [float(op["at"])])

    def dividers(self, op: dict) -> None:
        self.divide(self.find(op), [float(x) for x in op["at"]])

    def merge(self, op: dict) -> None:
        fs = [self.find({"id": i}) for i in op["ids"]]
        if len(fs) < 2 or len({f["page"] for f in fs}) > 1:
            raise Refused("can't be merged")
        fs.sort(key=lambda f: f["rect"]["top"])
        r = [f["rect"] for f in fs]
        fs[0] |= {"rect": {"left": min(x["left"] for x in r), "top": min(x["top"] for x in r), "right": max(x["right"] for x in r), "bottom": max(x["bottom"] for x in r)}}
        for f in fs[1:]:
            del self.frames[f["id"]]
        rest = self.parts(fs[0])
        if len(rest) == 1:
            rest[0]["unit"] = None

    def area(self, op: dict) -> None:
        parts, r = self.parts(self.find(op)), _rect(op["rect"])
        for i, p in enumerate(parts):
            p["rect"] = p["rect"] | {"left": r["left"], "right": r["right"]} | ({"top": r["top"]} if i == 0 else {}) | ({"bottom": r["bottom"]} if i == len(parts) - 1 else {})
            if p["rect"]["bottom"] - p["rect"]["top"] < LEAST:
                raise Refused("part too flat")

    # -- regions of a frame

    def _list(self, op: dict, field: str, most: int) -> None:
        f = self.parts(self.find(op))[0] if field == "context" else self.find(op)
        if f["kind"] != "exercise" and field != "continues":
            raise Refused("not an exercise")
        if field == "solution" and not f.get("authority"):
            raise Refused("no authority")
        verb = op["op"].split(".")[1]
        now = f.get(field) or []
        if verb == "add":
            new = _region(op)
            now = now + [new] if new not in now else now
        elif verb == "set":
            now = _regions(op["regions"])
        else:
            i = op.get("index", 0 if len(now) == 1 else None)
            if i is None or not 0 <= i < len(now):
                raise Refused("no such region")
            now = now[:i] + now[i + 1 :]
        if len(now) > most:
            raise Refused("too many regions")
        f[field] = now

    # -- authority

    def authority(self, op: dict) -> None:
        f = self.find(op)
        if op["op"] == "authority.mark":
            if f["kind"] != "exercise" or f.get("unit"):
                raise Refused("can't have authority")
            f |= {"authority": op.get("authority", "book"), "label": op["label"], "section": op["section"]}
        else:
            f |= {"authority": None, "label": None, "section": None, "solution": []}

    def rename(self, op: dict) -> None:
        f = self.find({"id": op["id"]})
        if not f.get("authority"):
            raise Refused("no authority")
        field = op["op"].split(".")[0]
        f[field] = op["value"]

    # -- outline

    def subtree(self, i: int) -> int:
        j = i + 1
        while j < len(self.outline) and self.outline[j]["depth"] > self.outline[i]["depth"]:
            j += 1
        return j

    def outline_op(self, op: dict) -> None:
        verb = op["op"].split(".")[1]
        if verb in ("set", "clear"):
            new = op["entries"] if verb == "set" else []
            gone = {e.get("id") for e in self.outline} - {e.get("id") for e in new}
            if any(self.used(s) for s in gone):
                raise Refused("section in use")
            self.outline = [dict(e) for e in new]
        elif verb == "add":
            self.outline.insert(int(op.get("at", len(self.outline))), {k: op.get(k) for k in ("title", "page", "depth", "id", "label", "top")})
        elif verb == "update":
            e = self.outline[self.entry(op)]
            if "id" in op and op["id"] != e.get("id"):
                if op["id"] is None and self.used(e.get("id")):
                    raise Refused("section in use")
                for f in self.frames.values():
                    if e.get("id") is not None and f.get("section") == e["id"]:
                        f["section"] = op["id"]
            e |= {k: op[k] for k in ("title", "page", "depth", "id", "label", "top") if k in op}
        elif verb == "delete":
            i = self.entry(op)
            j = self.subtree(i) if op.get("subtree") else i + 1
            if any(self.used(e.get("id")) for e in self.outline[i:j]):
                raise Refused("section in use")
            if not op.get("subtree"):
                for e in self.outline[i + 1 : self.subtree(i)]:
                    e["depth"] -= 1
            del self.outline[i:j]
        elif verb == "ids":
            taken = {e["id"] for e in self.outline if e.get("id")}
            for i, e in enumerate(self.outline):
                if not e.get("id"):
                    base = (e.get("label") or f"s{i + 1}").replace(" ", "-")
                    name, n = base, 2
                    while name in taken:
                        name, n = f"{base}-{n}", n + 1
                    e["id"] = name
                    taken.add(name)
        else:
            raise Refused("no such operation")

    def meta_set(self, op: dict) -> None:
        self.meta |= {k: v for k, v in op["values"].items() if v is not None}
        for k, v in op["values"].items():
            if v is None:
                self.meta.pop(k, None)

    def apply(self, op: dict) -> str | None:
        name = op["op"]
        simple = {"add": self.add, "update": self.update, "delete": self.delete, "move": self.move, "split": self.split, "merge": self.merge, "dividers": self.dividers, "area": self.area, "authority.mark": self.authority, "authority.unmark": self.authority, "label.set": self.rename, "section.set": self.rename, "meta.set": self.meta_set}
        if name in simple:
            return simple[name](op)
        field, _, verb = name.partition(".")
        if field == "outline":
            return self.outline_op(op)
        if (field, verb) in {(f, v) for f in ("context", "solution") for v in ("add", "remove", "set")} | {("continues", "add"), ("continues", "remove")}:
            return self._list(op, field, 16 if field == "solution" else 8)
        raise Refused("no such operation")


def replay(frames: list[dict], outline: list[dict], ops: list[dict], seq: int = 0, meta: dict | None = None) -> tuple[Book | None, int, str | None]:
    """The book after a batch, how many operations were done, and why it was refused; a refused batch changes nothing.

    `as` names the id that an operation makes, which later ones refer to as @name.
    """
    book = Book(json.loads(json.dumps(frames)), json.loads(json.dumps(outline)), seq, meta)
    names: dict[str, str] = {}

    def known(v: object) -> object:
        if isinstance(v, str) and v.startswith("@"):
            if v[1:] not in names:
                raise Refused(f"unknown name {v}")
            return names[v[1:]]
        return [known(x) for x in v] if isinstance(v, list) else v

    for i, op in enumerate(ops):
        try:
            made = book.apply({k: known(v) if k in ("id", "ids") else v for k, v in op.items()})
            if op.get("as") and made:
                names[op["as"]] = made
        except (Refused, KeyError, TypeError, IndexError) as e:
            return None, i, f"{op.get('op')}: {e}"
    return book, len(ops), None


def replay_all(state: DataFrame, operations: DataFrame) -> DataFrame:
    """STATE of every book of state(book_id, frames, outline, seq, meta as JSON) after its operations(book_id, seq_no, payload as JSON)."""
    s = state.select("book_id", F.lit(-1).cast("long").alias("seq_no"), F.to_json(F.struct("frames", "outline", "seq", "meta")).alias("payload"))
    o = operations.select("book_id", F.col("seq_no").cast("long").alias("seq_no"), "payload").join(state.select("book_id"), "book_id", "left_semi")
    names = [x.split()[0] for x in STATE.split(", ")]

    kind = to_arrow_schema(T.StructType.fromDDL(STATE))
    dump = lambda v: json.dumps(v, sort_keys=True)

    def after(book_id: str, payloads: list[str]) -> tuple:
        head = json.loads(payloads[0])
        frames, outline, meta = (json.loads(head.get(k) or d) for k, d in (("frames", "[]"), ("outline", "[]"), ("meta", "{}")))
        book, done, error = replay(frames, outline, [json.loads(x) for x in payloads[1:]], int(head.get("seq") or 0), meta)
        kept = book or Book(frames, outline, int(head.get("seq") or 0), meta)
        return book_id, book is not None, done, error, dump(sorted(kept.frames.values(), key=lambda f: f["id"])), dump(kept.outline), kept.seq, dump(kept.meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in whole_runs(batches, ["book_id"]):
            payloads = b.column("payload")
            for first in range(0, len(at) - 1, 500):
                books = [after(b.column("book_id")[i].as_py(), payloads[i:j].to_pylist()) for i, j in itertools.pairwise(at[first : first + 501])]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*books, strict=True), kind, strict=True)], names)

    bound_batches(state.sparkSession)
    return gathered(s.unionByName(o), ["book_id"], ["seq_no"]).mapInArrow(run, STATE)
