"""Cheapest edits of a conversation by a Viterbi search whose decided beginning is handed out as it goes.

The roles of a repaired conversation, by their initials, are `(s?(ua)+)?`. The search holds one survivor for each state of that
pattern: nothing yet (E), after the system turn (S), after a user's (U), after an assistant's (A). Survivors are leaves of a
tree of backpointers whose nodes count their references. What all survivors share, from the root on, is decided: it is handed out and
forgotten. Equal costs are settled by the edits' letters, compared from where the two paths part, to the end; paths
that part earlier than the root cannot tie any more. Survivors that another one beats whatever follows are dropped, so what is held doesn't
grow with the conversation.
"""

from __future__ import annotations

from collections.abc import Callable

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# initial -> state -> next state
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INSERTS = ((START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
# (state, other, most): `other` finishes at most that much dearer than `state` does, whatever follows
BEATEN = (
    (START, ASSISTANT, DELETE_COST),
    (START, USER, DELETE_COST + INSERT_COST),
    (SYSTEM, ASSISTANT, 0),
    (SYSTEM, USER, INSERT_COST),
    (USER, ASSISTANT, INSERT_COST),
    (ASSISTANT, USER, INSERT_COST),
)

Turn = tuple[str, str | None, str | None]  # letters, role, text


class Node:
    __slots__ = ("parent", "letters", "role", "text", "depth", "refs")

    def __init__(self, parent: Node | None, letters: str, role: str | None = None, text: str | None = None):
        self.parent, self.letters, self.role, self.text, self.refs = parent, letters, role, text, 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.refs += 1


def release(node: Node | None) -> None:
    """Give up one reference; nodes without any give up theirs."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        parent, node.parent = node.parent, None
        node = parent


def path_before(one: Node, other: Node) -> bool:
    """Whether the letters to `one` come before those to `other`, from where they part."""
    first, second = [], []
    while one is not other:
        if one.depth >= other.depth:
            first.append(one.letters)
            one = one.parent
        else:
            second.append(other.letters)
            other = other.parent
    return "".join(reversed(first)) < "".join(reversed(second))


class Search:
    """Feed rows in order, then finish. `emit` gets (letters, role, text) of each edit, role and text being None for deleted rows."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None], patience: int = 32):
        self.emit, self.patience, self.wait = emit, patience, patience
        self.root = Node(None, "")
        self.root.refs = 2  # the search's own, and the survivor's
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.held = 0  # most nodes from the root to a survivor

    def _replace(self, new: dict[int, tuple[int, Node]]) -> None:
        for _, node in new.values():
            node.refs += 1
        for _, node in self.best.values():
            release(node)
        self.best = new

    @staticmethod
    def _offer(found: dict[int, tuple[int, Node]], state: int, cost: int, parent: Node, *edit) -> None:
        """Take a path if it is cheaper, or as cheap and its letters come first."""
        old = found.get(state)
        if old is not None and old[0] < cost:
            return
        node = Node(parent, *edit)
        if old is not None and old[0] == cost and not path_before(node, old[1]):
            parent.refs -= 1
            return
        found[state] = (cost, node)
        if old is not None and not old[1].refs:
            Search._drop(old[1])

    @staticmethod
    def _drop(node: Node) -> None:
        """A node that nothing refers to gives up its parent."""
        parent, node.parent = node.parent, None
        release(parent)

    def _inserted(self) -> dict[int, tuple[int, Node]]:
        """The survivors and what insertions make of them."""
        found = dict(self.best)
        for _ in range(2):  # a third insertion in a row leads back to a state that is cheaper already
            for state, after in INSERTS:
                if state in found:
                    cost, node = found[state]
                    if after not in found or cost + INSERT_COST <= found[after][0]:
                        self._offer(found, after, cost + INSERT_COST, node, INSERT, ROLES[after], "")
        return found

    def delete(self, count: int) -> None:
        """Rows that have to go. Insertions before them are never first in letters, so they wait."""
        if count:
            self._replace(
                {s: (c + DELETE_COST * count, Node(n, DELETE * count)) for s, (c, n) in self.best.items()}
            )
            self._settle()

    def row(self, role: str, text: str, truncated: bool) -> None:
        """A row that may be kept, given another role, or deleted."""
        extra = TRUNCATED_COST if truncated else 0
        before, found = self._inserted(), {}
        own = MOVES.get(role[:1], {})
        for state, (cost, node) in before.items():
            node.refs += 1  # held while its followers are made
        for state, (cost, node) in before.items():
            self._offer(found, state, cost + DELETE_COST, node, DELETE)
            if state in own:
                self._offer(found, own[state], cost + extra, node, KEEP, role, text)
            for initial in "ua":
                after = MOVES[initial].get(state)
                if after is not None and after != own.get(state):
                    self._offer(found, after, cost + extra + REROLE_COST, node, REROLE, ROLES[after], text)
        for state, other, most in BEATEN:
            if state in found and other in found and found[other][0] + most < found[state][0]:
                self._drop(found.pop(state)[1])
        self._replace(found)
        for _, node in before.values():
            release(node)
        self._settle()

    def _settle(self) -> None:
        """Hand out what all survivors share. Looked for once the tree may have doubled, so the walks add up to little."""
        self.wait -= 1
        if self.wait > 0:
            return
        self._flush()
        depth = max(n.depth for _, n in self.best.values()) - self.root.depth
        self.held = max(self.held, depth)
        self.wait = max(self.patience, depth)

    def _flush(self) -> None:
        path, node = [], next(iter(self.best.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        # the root is shared by all; so is the only child of a shared node that is no survivor itself
        ends = {id(n) for _, n in self.best.values()}
        while path and self.root.refs == 2 and id(self.root) not in ends:
            node = path.pop()
            self.emit(node.letters, node.role, node.text)
            node.parent = None
            node.refs += 1  # the search's own reference moves on
            self.root = node

    def finish(self) -> int:
        """Hand out the rest of the cheapest path; its cost."""
        before = self._inserted()
        cost, node = before.get(START, (None, None))
        if ASSISTANT in before:
            other, end = before[ASSISTANT]
            if cost is None or other < cost or (other == cost and path_before(end, node)):
                cost, node = other, end
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.letters, node.role, node.text)
        return cost
