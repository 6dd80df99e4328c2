"""Open documents and their schema, as an editor sees them. In one process: a document at a time needs no cluster."""

from __future__ import annotations

import os

from querywright.operators.analyze import analyze_text
from querywright.operators.catalog import Catalog, build_catalog
from querywright.operators.lookup import completions, hover, word_at
from querywright.sources.config import Config, find_config, read_config
from querywright.sources.files import expand, schema_files

SEVERITY = {"error": 1, "warning": 2, "info": 3}
KINDS = {"table": 22, "view": 8, "column": 5}


class Workspace:
    def __init__(self, root: str = "."):
        self.root, self.documents, self.config = root, {}, Config()
        self.catalog = Catalog()
        self.reload()

    def reload(self) -> None:
        """Reads the configuration and the schema files again."""
        found = find_config(self.root)
        self.config = read_config(found) if found else Config()
        base = os.path.dirname(found) if found else self.root
        paths = expand([os.path.join(base, p) for p in self.config.schema]) + (schema_files(os.path.join(base, self.config.schema_dir)) if self.config.schema_dir else [])
        self.schema_paths = {os.path.abspath(p) for p in paths}
        texts = []
        for p in paths:
            if os.path.isfile(p):
                with open(p, encoding="utf-8") as f:
                    texts.append(f.read())
        self.catalog = build_catalog(texts, self.dialect)

    @property
    def dialect(self) -> str:
        return self.config.dialect or "postgresql"

    def diagnose(self, uri: str) -> list[dict]:
        """Diagnostics of an open document, places counted from 0 and help put under the message."""
        out = []
        for d in analyze_text(self.documents[uri], self.catalog, self.dialect):
            if d["code"] in self.config.disable:
                continue
            line, column = max(0, d["line"] - 1), max(0, d["column"] - 1)
            place = {"start": {"line": line, "character": column}, "end": {"line": line, "character": column + d["length"]}}
            out.append({"range": place, "severity": SEVERITY[d["severity"]], "code": d["code"], "source": "querywright", "message": d["message"] + (f"\n{d['help']}" if d["help"] else "")})
        return out

    def hover(self, uri: str, line: int, character: int) -> str | None:
        word = word_at(self.documents.get(uri, ""), line, character)
        return hover(self.catalog, word) if word else None

    def completions(self) -> list[dict]:
        return [{"label": label, "kind": KINDS[kind], "detail": detail} for label, kind, detail in completions(self.catalog)]

    def saved(self, path: str) -> list[str]:
        """Documents to diagnose after a file was saved: all, if it is part of the schema."""
        if os.path.abspath(path) in self.schema_paths or os.path.basename(path) == "querywright.toml":
            self.reload()
            return list(self.documents)
        return []
