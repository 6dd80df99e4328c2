"""python -m querywright.lsp: a language server over standard input and output."""

from __future__ import annotations

import json
import sys
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from querywright.operators.workspace import Workspace


def read_message(stream: BinaryIO) -> dict | None:
    """The next message, None at the end."""
    size = None
    while line := stream.readline():
        line = line.strip()
        if not line:
            if size is None:
                continue
            return json.loads(stream.read(size))
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            size = int(value)
    return None


def write_message(stream: BinaryIO, message: dict) -> None:
    body = json.dumps({"jsonrpc": "2.0", **message}).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    stream.flush()


def path_of(uri: str) -> str:
    return unquote(urlparse(uri).path) if uri.startswith("file:") else uri


class Server:
    def __init__(self, out: BinaryIO):
        self.out, self.space, self.stopped = out, Workspace(), False

    def publish(self, uri: str) -> None:
        found = self.space.diagnose(uri) if uri in self.space.documents else []
        write_message(self.out, {"method": "textDocument/publishDiagnostics", "params": {"uri": uri, "diagnostics": found}})

    def handle(self, message: dict) -> None:
        method, params = message.get("method", ""), message.get("params") or {}
        uri = params.get("textDocument", {}).get("uri", "")
        result = None
        if method == "initialize":
            root = params.get("rootUri") or params.get("rootPath")
            if root:
                self.space = Workspace(path_of(root))
            result = {"capabilities": {"textDocumentSync": {"openClose": True, "change": 1, "save": True}, "hoverProvider": True, "completionProvider": {}}, "serverInfo": {"name": "querywright"}}
        elif method == "textDocument/didOpen":
            self.space.documents[uri] = params["textDocument"]["text"]
            self.publish(uri)
        elif method == "textDocument/didChange":
            self.space.documents[uri] = params["contentChanges"][-1]["text"]
            self.publish(uri)
        elif method == "textDocument/didSave":
            for other in self.space.saved(path_of(uri)):
                self.publish(other)
        elif method == "textDocument/didClose":
            self.space.documents.pop(uri, None)
            self.publish(uri)
        elif method == "textDocument/hover":
            text = self.space.hover(uri, params["position"]["line"], params["position"]["character"])
            result = {"contents": {"kind": "markdown", "value": text}} if text else None
        elif method == "textDocument/completion":
            result = self.space.completions()
        elif method == "exit":
            self.stopped = True
        elif "id" in message and method != "shutdown":
            write_message(self.out, {"id": message["id"], "error": {"code": -32601, "message": f"no method {method}"}})
            return
        if "id" in message:
            write_message(self.out, {"id": message["id"], "result": result})


def main(source: BinaryIO | None = None, out: BinaryIO | None = None) -> None:
    source, server = source or sys.stdin.buffer, Server(out or sys.stdout.buffer)
    while not server.stopped and (message := read_message(source)) is not None:
        server.handle(message)


if __name__ == "__main__":
    main()
