"""A minimal acyclic transducer: frequent words in, their place in a table of ids out.

Words sharing endings share states. Each arc carries the number of words that sort before those it
leads to, so the sum along a path is the word's rank, and the rank points into the id table. The
whole automaton is a few flat arrays in one file, which workers memory-map and search for many words at once.
"""

from __future__ import annotations

import json

import numpy as np

_PARTS = ("keys", "targets", "outputs", "finals", "offsets", "ids")


def compile_words(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The automaton of distinct sorted ``words`` with their id lists."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path, last = [0], b""

    def close(depth: int) -> None:
        """Replace the states of ``path`` below ``depth`` by equal ones that exist already."""
        while len(path) - 1 > depth:
            state = path.pop()
            shape = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][last[len(path) - 1]] = register.setdefault(shape, state)

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    close(0)

    # Number the reachable states and count the words that end at or behind each of them.
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for target in arcs[stack.pop()].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
                stack.append(target)
    counts: dict[int, int] = {}
    todo = [0]
    while todo:
        state = todo[-1]
        missing = [t for t in arcs[state].values() if t not in counts]
        if missing:
            todo.extend(missing)
        else:
            counts[state] = final[state] + sum(counts[t] for t in arcs[state].values())
            todo.pop()
    keys, targets, outputs = [], [], []
    for state in order:
        before = int(final[state])
        for byte, target in sorted(arcs[state].items()):
            keys.append(number[state] << 8 | byte)
            targets.append(number[target])
            outputs.append(before)
            before += counts[target]
    by = np.argsort(keys, kind="stable")
    return {
        "keys": np.array(keys, np.int64)[by],
        "targets": np.array(targets, np.int32)[by],
        "outputs": np.array(outputs, np.int32)[by],
        "finals": np.array([final[s] for s in order], np.uint8),
        "offsets": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.uint32),
    }


def save(automaton: dict[str, np.ndarray], path: str) -> None:
    """One file: a line of JSON with the layout, then the arrays."""
    at, layout = 0, []
    for part in _PARTS:
        array = automaton[part]
        layout.append([part, array.dtype.str, len(array), at])
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(layout).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    with open(path, "wb") as out:
        out.write(head)
        for part in _PARTS:
            raw = automaton[part].tobytes()
            out.write(raw + b"\0" * (-len(raw) % 8))


class Lexicon:
    """A memory-mapped automaton file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        for part, dtype, n, at in json.loads(head):
            array = np.memmap(path, dtype=dtype, mode="r", offset=len(head) + at, shape=(n,)) if n else np.zeros(0, dtype)
            setattr(self, part, np.asarray(array))  # still the mapped file, without the cost of memmap's indexing

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where the lexicon lacks it; all words step through the arcs together."""
        n = len(words)
        rank, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else lengths
        alive = np.arange(n)
        out = np.full(n, -1, np.int64)
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            done = alive[ended]
            accepted = done[self.finals[state[done]] == 1]
            out[accepted] = rank[accepted]
            alive = alive[~ended]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | flat[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            alive, at = alive[there], at[there]
            rank[alive] += self.outputs[at]
            state[alive] = self.targets[at]
            step += 1
        return out

    def packed_ids(self, ranks: np.ndarray) -> list[bytes | None]:
        """The ids of each rank as 32-bit integers in a row, None for -1."""
        known = ranks[ranks >= 0]
        begin, end = self.offsets[known], self.offsets[known + 1]
        sizes = end - begin
        ends = np.cumsum(sizes)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - begin, sizes)].tobytes()
        packed = iter([flat[b - n : b] for b, n in zip((4 * ends).tolist(), (4 * sizes).tolist(), strict=True)])
        return [next(packed) if r >= 0 else None for r in ranks.tolist()]

    def ids_of_all(self, ranks: np.ndarray) -> list[list[int] | None]:
        """``packed_ids`` as lists."""
        return [None if x is None else np.frombuffer(x, np.uint32).tolist() for x in self.packed_ids(ranks)]
