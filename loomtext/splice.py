"""One tree changed by paths of child indexes; what does not change is shared with the old tree. Unexpected nodes are opaque."""

from __future__ import annotations

from .machine import Node


def find_node(root: Node, path: list[int]) -> Node | None:
    """The node at a path; None if there is none."""
    for i in path:
        if root.cls == "unexpected" or not root.children or not 0 <= i < len(root.children):
            return None
        root = root.children[i]
    return root


def node_length(node: Node) -> int:
    return node.width


def path_to_offset(root: Node, offset: int) -> list[int] | None:
    """The path to the deepest node over an offset, the end exclusive; None outside the text."""
    if not 0 <= offset < root.width:
        return None
    path: list[int] = []
    while root.children and root.cls != "unexpected":
        for i, child in enumerate(root.children):
            if offset < child.width:
                path.append(i)
                root = child
                break
            offset -= child.width
        else:
            break  # the node's own text
    return path


def _rebuilt(root: Node, path: list[int], change) -> Node | None:
    chain = [root]
    for i in path:
        if chain[-1].cls == "unexpected" or not chain[-1].children or not 0 <= i < len(chain[-1].children):
            return None
        chain.append(chain[-1].children[i])
    new = change(chain.pop())
    for i, parent in zip(reversed(path), reversed(chain), strict=True):
        if new is None:
            return None
        new = Node(parent.cls, parent.kind, parent.text, [*parent.children[:i], new, *parent.children[i + 1 :]])
    return new


def replace_at(root: Node, path: list[int], new: Node) -> Node | None:
    """The tree with another node at a path; None if there is no such place."""
    return _rebuilt(root, path, lambda _: new)


def replace_child_range(root: Node, path: list[int], start: int, stop: int, new: list[Node]) -> Node | None:
    """The tree with the children [start, stop) of the node at a path put as others; None if there are no such children."""

    def change(node: Node) -> Node | None:
        kids = node.children or []
        if node.cls == "unexpected" or not 0 <= start <= stop <= len(kids):
            return None
        return Node(node.cls, node.kind, node.text, [*kids[:start], *new, *kids[stop:]])

    return _rebuilt(root, path, change)
