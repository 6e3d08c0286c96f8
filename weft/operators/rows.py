"""Entity and edge rows of one file while they are collected."""

from __future__ import annotations

import bisect
import hashlib
import json

FACT, RESOLVED, INFERRED = "fact", "resolved", "inferred"


def stable_id(path: str, kind: str, qualified_name: str, discriminator: str = "", source: str = "workspace") -> str:
    """The same identity as weft.functions.exprs.stable_id."""
    return hashlib.sha256("\0".join((source, path, kind, qualified_name, discriminator)).encode()).hexdigest()


class FileRows:
    """Rows keep the order in which they came (seq); of equal keys the last counts when they are stored."""

    def __init__(self, path: str, text: str, file_hash: str):
        self.path, self.text = path, text
        self.lines = text.split("\n")
        self._ends = [i for i, c in enumerate(text) if c == "\n"]
        self.entities: list[dict] = []
        self.edges: list[dict] = []
        self._by_id: dict[str, dict] = {}
        self.file_id = stable_id(path, "file", path)
        self._add(self.file_id, "file", path.rsplit("/", 1)[-1], path, {"content_hash": file_hash}, self._evidence(1, FACT, 1.0, "discovered source file"))

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self._ends, offset) + 1

    def _evidence(self, line: int, classification: str, confidence: float, reason: str) -> dict:
        snippet = self.lines[line - 1].strip() if 0 < line <= len(self.lines) else None
        return {"file": self.path, "start_line": line, "end_line": line, "classification": classification, "confidence": max(0.0, min(1.0, confidence)), "reason": reason, "snippet": snippet}

    def _add(self, id_: str, kind: str, name: str, qualified_name: str, meta: dict, evidence: dict) -> None:
        row = {"id": id_, "kind": kind, "name": name, "qualified_name": qualified_name, "file": self.path, "meta": meta, "evidence": evidence}
        self.entities.append(row)
        self._by_id[id_] = row

    def id_of(self, kind: str, name: str, qualified_name: str | None = None, discriminator: str = "") -> str:
        return stable_id(self.path, kind, qualified_name or name, discriminator)

    def entity(self, kind: str, name: str, qualified_name: str, at: int, *, discriminator: str = "", meta: dict | None = None, classification: str = FACT, confidence: float = 1.0, contained: bool = False, reason: str = "") -> str:
        id_ = stable_id(self.path, kind, qualified_name if kind != "method" else name, discriminator)
        self._add(id_, kind, name, qualified_name, dict(meta or {}), self._evidence(self.line(at), classification, confidence, reason))
        if contained:
            self.edge(self.file_id, id_, "contains", at, reason="file contains it")
        return id_

    def edge(self, source: str, target: str, kind: str, at: int, classification: str = FACT, confidence: float = 1.0, reason: str = "", line: int | None = None) -> None:
        self.edges.append({"source": source, "target": target, "kind": kind, "file": self.path, "evidence": self._evidence(line or self.line(at), classification, confidence, reason)})

    def meta(self, id_: str) -> dict:
        return self._by_id[id_]["meta"]

    def add_meta(self, id_: str, more: dict) -> None:
        self._by_id[id_]["meta"].update(more)

    def rows(self):
        """(entities, edges) as tuples in the order of weft.schema.ENTITY and weft.schema.EDGE."""
        e = [(r["id"], r["kind"], r["name"], r["qualified_name"], r["file"], json.dumps(r["meta"], sort_keys=True), [r["evidence"]], i) for i, r in enumerate(self.entities)]
        g = [(r["source"], r["target"], r["kind"], r["file"], [r["evidence"]], i) for i, r in enumerate(self.edges)]
        return e, g
