"""Trees of SQL statements. One class: what differs between constructs is the kind, the children and a few fields."""

from __future__ import annotations

from collections.abc import Iterator

from querywright.sources.lexer import Span


class Name:
    """An identifier as written."""

    __slots__ = ("text", "quoted", "span")

    def __init__(self, text: str, quoted: bool, span: Span):
        self.text, self.quoted, self.span = text, quoted, span

    def __repr__(self) -> str:
        return f'"{self.text}"' if self.quoted else self.text


class Node:
    """kind, span of the first token to the last on its line, children, and named fields (`node.name`; None if absent)."""

    def __init__(self, kind: str, span: Span | None = None, kids: list | None = None, **fields):
        self.kind, self.span, self.kids, self.fields = kind, span or Span(), kids if kids is not None else [], fields

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return self.fields.get(name)

    def walk(self) -> Iterator[Node]:
        """This node and all below it, queries in expressions not entered."""
        yield self
        for k in self.kids:
            yield from k.walk()

    def show(self, depth: int = 0) -> str:
        """One line for each node."""
        own = ", ".join(f"{k}={v!r}" for k, v in self.fields.items() if v not in (None, [], False) and not _has_nodes(v))
        lines = ["  " * depth + self.kind + (f"({own})" if own else "")]
        for k, v in self.fields.items():
            if _has_nodes(v):
                lines.append("  " * (depth + 1) + f"{k}:")
                lines += [_show(x, depth + 2) for x in (v if isinstance(v, (list, tuple)) else [v])]
        return "\n".join(lines + [x.show(depth + 1) for x in self.kids])


def _has_nodes(v) -> bool:
    return isinstance(v, Node) or isinstance(v, (list, tuple)) and any(_has_nodes(x) for x in v)


def _show(v, depth: int) -> str:
    if isinstance(v, Node):
        return v.show(depth)
    if isinstance(v, (list, tuple)):
        return "\n".join(_show(x, depth) for x in v)
    return "  " * depth + repr(v)
