"""Column expressions as SQL text, so that SQL functions can be made of the library's own Columns.

Needs a classic session: the expression is read from the Column's tree on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column

_INFIX = {"and", "or", "=", "==", "<=>", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "&", "|", "^", "like", "rlike"}


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _call(node) -> str:
    name, args = node.functionName(), [_text(a) for a in _items(node.arguments())]
    if name.lower() in _INFIX and len(args) == 2:
        return f"({args[0]} {name} {args[1]})"
    if name in ("!", "not"):
        return f"(NOT {args[0]})"
    if name.lower() == "in":
        return f"({args[0]} IN ({', '.join(args[1:])}))"
    if name in ("negative", "~") and len(args) == 1:
        return f"({'-' if name == 'negative' else '~'} {args[0]})"
    return f"{name}({', '.join(args)})"


def _case(node) -> str:
    branches = [f"WHEN {_text(b._1())} THEN {_text(b._2())}" for b in _items(node.branches())]
    last = node.otherwise()
    return f"CASE {' '.join(branches)} {f'ELSE {_text(last.get())} ' if last.isDefined() else ''}END"


def _text(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        return _call(node)
    if kind == "Literal":
        return node.sql()
    if kind == "CaseWhenOtherwise":
        return _case(node)
    if kind == "Cast":
        cast = "TRY_CAST" if node.sql().startswith("TRY_CAST") else "CAST"
        return f"{cast}({_text(node.child())} AS {node.dataType().sql()})"
    if kind == "LambdaFunction":
        names = [_text(a) for a in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_text(node.function())}"
    if kind == "UnresolvedNamedLambdaVariable":
        return _name(node.name())
    if kind == "UnresolvedAttribute":
        return ".".join(_name(p) for p in _items(node.nameParts()))
    if kind == "UnresolvedExtractValue":
        return f"{_text(node.child())}[{_text(node.extraction())}]"
    if kind == "Alias":
        return f"{_text(node.child())} AS {_name(next(_items(node.name())))}"
    raise ValueError(f"No SQL text for {kind}: {node.sql()}")


def column_text(column: Column) -> str:
    """SQL text of a Column of built-in functions."""
    return _text(column._jc.node())
