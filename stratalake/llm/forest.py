"""Decision trees of pyspark.ml as plain values and as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Test:
    """feature <= threshold if ``below``, else feature > threshold."""

    feature: str
    below: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value <= F.lit(self.threshold) if self.below else value > F.lit(self.threshold)


@dataclass
class Node:
    """``share`` is the share of label 1 among the training rows that came here."""

    share: float
    feature: str = ""
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def read_trees(model, features: list[str]) -> list[Node]:
    """The trees of a fitted random forest over continuous features."""
    return [_read(tree._java_obj.rootNode(), features) for tree in model.trees]


def _read(node, features: list[str]) -> Node:
    counts = list(node.impurityStats().stats())
    share = counts[1] / sum(counts) if len(counts) > 1 and sum(counts) else 0.0
    if node.subtreeDepth() == 0:
        return Node(share)
    cut = node.split()
    return Node(
        share,
        features[cut.featureIndex()],
        cut.threshold(),
        _read(node.leftChild(), features),
        _read(node.rightChild(), features),
    )


def paths(node: Node, so_far: tuple[Test, ...] = ()) -> list[tuple[Test, ...]]:
    """The conjunction that leads to each node below the root."""
    if node.left is None or node.right is None:
        return [so_far] if so_far else []
    below = Test(node.feature, True, node.threshold)
    above = Test(node.feature, False, node.threshold)
    own = [so_far] if so_far else []
    return own + paths(node.left, (*so_far, below)) + paths(node.right, (*so_far, above))


def vote(node: Node) -> Column:
    """The tree's share of label 1 as nested conditions."""
    if node.left is None or node.right is None:
        return F.lit(node.share)
    test = Test(node.feature, True, node.threshold).column()
    return F.when(test, vote(node.left)).otherwise(vote(node.right))


def rule(tests: tuple[Test, ...]) -> Column:
    """1.0 where all tests hold, else 0.0."""
    holds = tests[0].column()
    for test in tests[1:]:
        holds = holds & test.column()
    return F.when(holds, 1.0).otherwise(0.0)
