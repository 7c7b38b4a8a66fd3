"""Merge rules of a BPE vocabulary, and which tokens can stand side by side.

The encoding of a text is the one chain of tokens in which every two
neighbours stay apart: encoding the bytes of both gives both. So a prefix of a
text has one last token, whatever follows, and it is found from left to right.

Whether ``u`` and ``v`` stay apart is read off their merges backwards in time.
Of ``u`` only what ends at the border matters (itself, its right part, that
one's right part, ...), of ``v`` only what starts there. Both exist together
until one is merged away inside its own token; a rule that joins them before
that crosses the border. Of two merges of one rank the left one comes first.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

#: The rank of no merge.
NEVER = 1 << 40
#: What a worker keeps: pairs of neighbours, states of the machine, bytes of the
#: table of pieces, and the longest piece in it.
PAIRS = 1 << 19
STATES = 1 << 18
TABLE_BYTES = 128 << 20
SHORT = 64


class Merges:
    """``rules`` are ``(left, right, merged)`` ids by rank; ``spelled`` gives the
    bytes of an id. A rule whose parts would not stay side by side until its
    turn never applies, so its token is no node of ``steps``."""

    def __init__(self, rules: Iterable[tuple[int, int, int]], spelled: dict[int, bytes]):
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {i: -1 for i, b in spelled.items() if len(b) == 1}
        self.pair: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for rank, (u, v, merged) in enumerate(rules):
            if u not in self.rank or v not in self.rank or not self._apart(u, v, rank):
                continue
            if merged in self.parts:
                raise ValueError(f"two rules make token {merged}")
            self.parts[merged], self.rank[merged], self.pair[u, v] = (u, v), rank, rank
        #: spelling automaton: node << 8 | byte -> node; depth of a node; tokens
        #: by the node that ends them; nodes that go on; size of a token
        self.steps: dict[int, int] = {}
        self.depth = [0]
        self.ends: dict[int, int] = {}
        self.inner: set[int] = set()
        self.size = {i: len(spelled[i]) for i in self.rank}
        for token in self.rank:
            node = 0
            for n, b in enumerate(spelled[token], 1):
                self.inner.add(node)
                node = self.steps.setdefault(node << 8 | b, len(self.depth))
                if node == len(self.depth):
                    self.depth.append(n)
            self.ends[node] = token

    def _apart(self, u: int, v: int, first: int = NEVER) -> bool:
        """No rule of a rank below ``first`` joins across the border of u and v."""
        u_dies = v_dies = first
        while True:
            joined = self.pair.get((u, v), NEVER)
            if joined < u_dies and joined <= v_dies and joined < first:
                return False
            born_u, born_v = self.rank[u], self.rank[v]
            if born_u < 0 and born_v < 0:
                return True
            if born_u > born_v:
                u, u_dies = self.parts[u][1], born_u
            else:
                v, v_dies = self.parts[v][0], born_v

    def apart(self, u: int, v: int) -> bool:
        """Whether ``v`` can follow ``u``."""
        found = self.known.get((u, v))
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[u, v] = self._apart(u, v)
        return found


class Machine:
    """Reads bytes from left to right and tells the last token of each prefix.

    ``items[s]`` are the states ``node << 32 | token before`` (-1 wrapped: none)
    that determinised state ``s`` stands for, the oldest beginning first; the
    last one begins here, after the token ``last[s]``. ``to`` holds the
    transitions built so far, by ``s << 8 | byte``.
    """

    NONE = (1 << 32) - 1

    def __init__(self, merges: Merges):
        self.merges = merges
        self._clear()

    def _clear(self) -> None:
        self.items: list[tuple[int, ...]] = []
        self.last: list[int] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.to: dict[int, int] = {}
        self._state((self.NONE,))

    def _state(self, items: tuple[int, ...]) -> int:
        found = self.known.get(items)
        if found is None:
            found = self.known[items] = len(self.items)
            self.items.append(items)
            self.last.append(items[-1])
        return found

    def _build(self, key: int) -> int:
        """The transition of a state and byte met for the first time."""
        m, byte, live, made = self.merges, key & 255, [], None
        for item in self.items[key >> 8]:
            node = m.steps.get(item >> 32 << 8 | byte)
            if node is None:
                continue
            before = item & self.NONE
            if node in m.inner:
                live.append(node << 32 | before)
            if made is None:  # of the tokens that end here one can follow its token before
                token = m.ends.get(node)
                if token is not None and (before == self.NONE or m.apart(before, token)):
                    made = token
        live.append(made)  # node 0 after the token just made
        found = self.to[key] = self._state(tuple(live))
        return found

    def read(self, state: int, data: bytes, said: list[int]) -> int:
        """The state after ``data``; ``said`` gets the token that ends after each byte."""
        if len(self.items) > STATES:
            items = self.items[state]
            self._clear()
            state = self._state(items)
        get, path = self.to.get, []
        for byte in data:
            key = state << 8 | byte
            state = get(key)
            if state is None:
                state = self._build(key)
            path.append(state)
        said += map(self.last.__getitem__, path)
        return state

    def chain(self, said: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes; ``said[i]`` ends after byte ``i``."""
        out, size = [], self.merges.size
        while end:
            out.append(said[end - 1])
            end -= size[out[-1]]
        out.reverse()
        return out

    def certain(self, said: list[int], state: int) -> int:
        """Where the chains of all live beginnings meet: what is before it
        stands whatever follows."""
        ends = {len(said) - self.merges.depth[i >> 32] for i in self.items[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self.merges.size[said[far - 1]])
        return ends.pop()


class Table(dict):
    """Ids of pieces met before, made by ``make``; full, it starts anew. Long
    pieces aren't kept."""

    def __init__(self, make: Callable[[str], Iterable[int]]):
        super().__init__()
        self.make, self.used = make, 0

    def __missing__(self, piece: str) -> Iterable[int]:
        if len(piece) > SHORT:
            return self.make(piece)
        ids = tuple(self.make(piece))
        if self.used > TABLE_BYTES:
            self.clear()
            self.used = 0
        self.used += 256 + 4 * len(piece) + 8 * len(ids)
        self[piece] = ids
        return ids


def spare_collector() -> None:
    """The tables grow by many small objects that all stay: look for cycles less often."""
    gc.set_threshold(1 << 18)
