import io
import json

from querywright import lsp


def talk(*messages):
    source, out = io.BytesIO(), io.BytesIO()
    for m in messages:
        body = json.dumps({"jsonrpc": "2.0", **m}).encode()
        source.write(b"Content-Length: %d\r\nContent-Type: x\r\n\r\n" % len(body) + body)
    source.seek(0)
    lsp.main(source, out)
    out.seek(0)
    found = []
    while (m := lsp.read_message(out)) is not None:
        found.append(m)
    return found


def test_a_session(tmp_path):
    (tmp_path / "s.sql").write_text("CREATE TABLE cats (id int PRIMARY KEY, name text)")
    (tmp_path / "querywright.toml").write_text('schema = ["s.sql"]\ndisable = ["E0003"]\n')
    doc = {"uri": f"file://{tmp_path}/q.sql"}
    got = talk(
        {"id": 1, "method": "initialize", "params": {"rootUri": f"file://{tmp_path}"}},
        {"method": "initialized"},
        {"method": "textDocument/didOpen", "params": {"textDocument": {**doc, "text": "SELECT naem FROM cats\nWHERE id = name"}}},
        {"method": "textDocument/didChange", "params": {"textDocument": doc, "contentChanges": [{"text": "SELECT name FROM cats"}]}},
        {"id": 2, "method": "textDocument/hover", "params": {"textDocument": doc, "position": {"line": 0, "character": 19}}},
        {"id": 3, "method": "textDocument/completion", "params": {"textDocument": doc}},
        {"method": "textDocument/didSave", "params": {"textDocument": {"uri": f"file://{tmp_path}/s.sql"}}},
        {"id": 4, "method": "no/such"},
        {"method": "textDocument/didClose", "params": {"textDocument": doc}},
        {"id": 5, "method": "shutdown"},
        {"method": "exit"},
    )
    assert got[0]["result"]["capabilities"]["hoverProvider"]
    (d,) = got[1]["params"]["diagnostics"]
    assert d["range"]["start"] == {"line": 0, "character": 7} and d["message"].endswith("Did you mean 'name'?") and d["severity"] == 1
    assert got[2]["params"]["diagnostics"] == [] and "**Table: cats**" in got[3]["result"]["contents"]["value"]
    assert [x["label"] for x in got[4]["result"]] == ["cats", "id", "name"]
    assert got[5]["method"] == "textDocument/publishDiagnostics" and got[6]["error"]["code"] == -32601 and got[8]["id"] == 5
