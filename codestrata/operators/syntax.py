"""Symbols and calls of Python files by their syntax tree.

The standard library parses Python; for other languages, and for text that it rejects, the
line parser stands in.  Unlike that one it knows spans, enclosing scopes, base classes and
all calls of an expression.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _span(node: ast.AST) -> dict:
    return {"line": node.lineno, "col": node.col_offset, "end_line": node.end_lineno, "end_col": node.end_col_offset}


def _ordered(node: ast.AST) -> list[ast.AST]:
    """Children in the order of the text."""
    children = [c for c in ast.iter_child_nodes(node) if hasattr(c, "lineno") or not isinstance(c, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop))]
    return sorted(children, key=lambda c: (getattr(c, "lineno", 0), getattr(c, "col_offset", 0)))


def names_in(node: ast.AST) -> list[str]:
    """Identifiers of an expression in their order, names of keyword arguments and attributes included."""
    found: list[tuple[tuple[int, int], str]] = []
    for n in ast.walk(node):
        if isinstance(n, ast.Name):
            found.append(((n.lineno, n.col_offset), n.id))
        elif isinstance(n, ast.Attribute):
            found.append(((n.end_lineno, n.end_col_offset - len(n.attr.encode())), n.attr))
        elif isinstance(n, ast.keyword) and n.arg:
            found.append(((n.lineno, n.col_offset), n.arg))
    return [name for _, name in sorted(found)]


def _alias(a: ast.alias) -> str:
    return f"{a.name} as {a.asname}" if a.asname else a.name


def symbols(node: ast.AST, parent: str | None = None) -> Iterator[dict]:
    """Imports (the first name), classes, functions, methods and plain assignments below ``node``."""
    for child in _ordered(node):
        row = {"parent": parent, "source": None, "exported": False, "inherits": []}
        if isinstance(child, ast.Import):
            yield {**row, "kind": "import", "name": _alias(child.names[0]), **_span(child), "parent": None}
        elif isinstance(child, ast.ImportFrom):
            if child.names[0].name != "*":
                yield {**row, "kind": "import", "name": _alias(child.names[0]), **_span(child), "parent": None, "source": "." * child.level + (child.module or "")}
        elif isinstance(child, ast.ClassDef):
            bases = [n for b in sorted([*child.bases, *child.keywords], key=lambda b: (b.lineno, b.col_offset)) for n in ([b.arg, *names_in(b.value)] if isinstance(b, ast.keyword) and b.arg else names_in(b))]
            yield {**row, "kind": "class", "name": child.name, **_span(child), "inherits": list(dict.fromkeys(bases))}
            yield from symbols(child, child.name)
        elif isinstance(child, FUNCTIONS):
            yield {**row, "kind": "method" if parent else "function", "name": child.name, **_span(child)}
            yield from symbols(child, child.name)
        elif isinstance(child, (ast.Assign, ast.AnnAssign)):
            target = child.targets[0] if isinstance(child, ast.Assign) else child.target
            if isinstance(target, ast.Name):
                yield {**row, "kind": "variable", "name": target.id, **_span(child)}
        else:
            yield from symbols(child, parent)


def calls(node: ast.AST, caller: str | None = None) -> Iterator[dict]:
    """Calls below ``node``, outer ones first, with the nearest function around them."""
    for child in _ordered(node):
        if isinstance(child, ast.Call):
            called = names_in(child.func)
            callee = called[-1] if called else ast.unparse(child.func)
            yield {"caller": caller, "callee": callee, **_span(child), "recursive": caller == callee}
        if isinstance(child, FUNCTIONS):
            for outside in (*child.decorator_list, child.args, *filter(None, [child.returns])):
                yield from calls(ast.Expression(outside), child.name if outside not in child.decorator_list else caller)
            yield from calls(ast.Module(child.body, []), child.name)
        else:
            yield from calls(child, caller)


def parse_python(text: str) -> tuple[list[dict], list[dict]] | None:
    """Symbols and calls in the order of the text; None if it is no Python."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        made = [{"sym_ord": k, **s} for k, s in enumerate(symbols(tree))], [{"call_ord": k, **c} for k, c in enumerate(calls(tree))]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return made
