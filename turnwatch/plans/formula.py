"""Past-time temporal formulas turned into Spark columns.

Policy text such as ``H(P(asked) -> !answered)`` is rewritten to the equivalent
Python expression and read with the standard library, so operator precedence
comes from a mapping of symbols and no grammar is written here.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = ("Y", "P", "H", "S", "true", "false")
_SHAPE = re.compile(r"(?:[\s!&|()\w]|->)*")
_PIECE = re.compile(r"\w+|->|[!&|()]")
# Python operators whose relative binding equals that of the policy language:
# or < comparison < | < & < ~
_PYTHON = {"S": "or", "->": ">=", "!": "~"}


class FormulaError(ValueError):
    """The policy text is not a well-formed formula."""


@dataclass(frozen=True)
class Formula:
    op: str
    parts: tuple["Formula", ...] = ()
    name: str = ""

    @property
    def label(self) -> str:
        inner = [p.label for p in self.parts]
        if self.op == "atom":
            return self.name
        if len(inner) == 1:
            return f"{self.op}({inner[0]})"
        return f"({inner[0]} {self.op} {inner[1]})"

    def walk(self):
        for part in self.parts:
            yield from part.walk()
        yield self

    @property
    def propositions(self) -> list[str]:
        names = {n.name for n in self.walk() if n.op == "atom"}
        return sorted(names - {"true", "false"})

    @property
    def depth(self) -> int:
        below = max((p.depth for p in self.parts), default=0)
        return below + (self.op in ("Y", "Z", "P", "H", "S"))


def _spell(pieces: list[str]) -> tuple[str, dict[str, str]]:
    """The text as an expression Python can read, and what its placeholders stand for. Names are
    numbered, so that Python neither folds nor reserves any."""
    names: dict[str, str] = {}

    def spell(piece: str) -> str:
        if piece in _PYTHON:
            return _PYTHON[piece]
        if piece in ("Y", "P", "H"):
            return f"op_{piece}"
        return names.setdefault(piece, f"id_{len(names)}") if re.match(r"[^\W\d]", piece) else piece
    source = " ".join(spell(p) for p in pieces)
    return source, {v: k for k, v in names.items()}


def _build(tree: ast.AST, names: dict[str, str]) -> Formula:
    match tree:
        case ast.Name(id=name) if name in names:
            return Formula("atom", name=names[name])
        case ast.UnaryOp(op=ast.Invert(), operand=x):
            return Formula("!", (_build(x, names),))
        case ast.BinOp(left=a, op=ast.BitAnd() | ast.BitOr() as op, right=b):
            return Formula("&" if isinstance(op, ast.BitAnd) else "|", (_build(a, names), _build(b, names)))
        case ast.Compare(left=first, comparators=rest):
            *heads, out = [_build(x, names) for x in (first, *rest)]
            for head in reversed(heads):
                out = Formula("->", (head, out))
            return out
        case ast.BoolOp(values=values):
            out, *tail = [_build(x, names) for x in values]
            for nxt in tail:
                out = Formula("S", (out, nxt))
            return out
        case ast.Call(func=ast.Name(id="op_Y" | "op_P" | "op_H" as name), args=[x], keywords=[]):
            return Formula(name[3:], (_build(x, names),))
    raise FormulaError(f"not a formula: {ast.unparse(tree)}")


def read_formula(text: str) -> Formula:
    if not _SHAPE.fullmatch(text or ""):
        raise FormulaError(f"unexpected character in {text!r}")
    source, names = _spell(_PIECE.findall(text))
    try:
        return _build(ast.parse(source, mode="eval").body, names)
    except (SyntaxError, RecursionError, MemoryError) as err:
        raise FormulaError(f"cannot read {text!r}") from err


def weak_yesterday(f: Formula) -> Formula:
    """Previous value of ``f``, true at the first step (used for violation history)."""
    return Formula("Z", (f,))


def shared_levels(formulas: list[Formula]) -> list[list[Formula]]:
    """Distinct temporal sub-formulas of all policies, grouped by nesting depth."""
    seen: dict[str, Formula] = {}
    for f in formulas:
        for node in f.walk():
            if node.op in ("Y", "Z", "P", "H", "S"):
                seen.setdefault(node.label, node)
    depth = max((n.depth for n in seen.values()), default=0)
    return [[n for n in seen.values() if n.depth == d] for d in range(1, depth + 1)]


def boolean_column(f: Formula, slots: dict[str, str], props: dict[str, Column]) -> Column:
    """Value of ``f`` at a row, given columns that hold its temporal sub-formulas."""
    if f.label in slots:
        return F.col(slots[f.label])
    if f.op == "atom":
        if f.name in ("true", "false"):
            return F.lit(f.name == "true")
        return F.coalesce(props[f.name], F.lit(False)) if f.name in props else F.lit(False)
    a, *b = [boolean_column(p, slots, props) for p in f.parts]
    if f.op == "!":
        return ~a
    if f.op == "&":
        return a & b[0]
    return (a if f.op == "|" else ~a) | b[0]


def settled(f: Formula, cols: list[Column]) -> tuple[Column, bool]:
    """The value a row settles for P, H or S (null when the row leaves it as it was),
    with the value that holds before anything is settled."""
    if f.op == "P":
        return F.when(cols[0], True), False
    if f.op == "H":
        return F.when(~cols[0], False), True
    hold, start = cols
    return F.when(start, True).when(~hold, False), False


def before_first(f: Formula) -> bool:
    """Previous value of a node at the first step: true under weak yesterday and for H."""
    return f.op == "Z" or f.parts[0].op == "H"
