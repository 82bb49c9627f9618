"""Decision trees over sample properties: a small text language, its check, and its compilation to CASE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A test `property > value` with its branches, or a leaf (predictor and offset)."""

    prop: str | None = None
    value: int = 0
    more: "Node | None" = None
    other: "Node | None" = None
    predictor: str = ""
    offset: int = 0


def parse(text: str) -> Node:
    """`if <property> > <value> <branch> <branch>` with leaves `- <predictor> <offset>`."""
    words = text.split()
    at = 0

    def node() -> Node:
        nonlocal at
        if at >= len(words):
            raise ValueError("the tree ends early")
        if words[at] == "if":
            if at + 3 >= len(words) or words[at + 2] != ">":
                raise ValueError(f"expected a comparison after word {at}")
            prop, value = words[at + 1], int(words[at + 3])
            at += 4
            more = node()
            return Node(prop, value, more, node())
        if words[at] != "-" or at + 2 >= len(words):
            raise ValueError(f"expected a leaf at word {at}")
        at += 3
        return Node(predictor=words[at - 2], offset=int(words[at - 1]))

    out = node()
    if at != len(words):
        raise ValueError("words after the tree")
    return out


def check(tree: Node, height: int = 2048) -> list[str]:
    """What is wrong: too high, or a test that its ancestors already decide."""
    out: list[str] = []
    stack: list[tuple[Node, int, dict[str, tuple[float, float]]]] = [(tree, 1, {})]
    while stack:
        n, depth, known = stack.pop()
        if n.prop is None:
            continue
        if depth >= height:
            out.append("too high")
            continue
        low, high = known.get(n.prop, (float("-inf"), float("inf")))
        if not low <= n.value < high:
            out.append(f"{n.prop} > {n.value} is decided already")
        assert n.more and n.other
        stack += [(n.more, depth + 1, known | {n.prop: (n.value + 1, high)}), (n.other, depth + 1, known | {n.prop: (low, n.value)})]
    return out


def compile_case(tree: Node, leaf) -> Column:
    """The tree as one nested CASE, so that it is compiled with the rest of the plan; leaf(node) gives a leaf's value."""
    if tree.prop is None:
        return leaf(tree)
    assert tree.more and tree.other
    return F.when(F.col(tree.prop) > tree.value, compile_case(tree.more, leaf)).otherwise(compile_case(tree.other, leaf))
