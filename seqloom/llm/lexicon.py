"""A minimal acyclic transducer: words to lists of token ids, in flat arrays that can be memory-mapped.

The automaton is built from sorted words, merging equal suffixes as it goes, so each state exists once. Every edge knows how
many words come before it, and the sum along a word's path is the word's number; the number
points into one flat array of token ids. Equal output lists would keep suffixes from
being shared, numbering does not.
"""

from __future__ import annotations

import io
import json
from collections.abc import Sequence

import numpy as np


class Lexicon:
    """Flat arrays: ``key`` (state * 256 + byte, ascending), ``target``, ``skip``, ``final`` per state, ``off`` and ``ids`` per word."""

    NAMES = ("key", "target", "skip", "final", "off", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for n in self.NAMES:
            setattr(self, n, arrays[n])

    @classmethod
    def build(cls, words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> Lexicon:
        order = sorted(range(len(words)), key=lambda k: words[k])
        register: dict[tuple, int] = {}
        edges: list[dict[int, int]] = [{}]
        final = [False]
        free: list[int] = []
        path = [0]  # states along the last word
        prev = b""

        def new() -> int:
            if free:
                s = free.pop()
                edges[s], final[s] = {}, False
                return s
            edges.append({})
            final.append(False)
            return len(edges) - 1

        def minimise(down_to: int) -> None:
            while len(path) - 1 > down_to:
                s = path.pop()
                sig = (final[s], tuple(edges[s].items()))
                kept = register.setdefault(sig, s)
                if kept != s:
                    edges[path[-1]][prev[len(path) - 1]] = kept
                    free.append(s)

        for k in order:
            w = words[k]
            common = 0
            while common < min(len(w), len(prev)) and w[common] == prev[common]:
                common += 1
            minimise(common)
            for c in w[common:]:
                s = new()
                edges[path[-1]][c] = s
                path.append(s)
            final[path[-1]] = True
            prev = w
        minimise(0)

        number: dict[int, int] = {0: 0}  # breadth-first numbering of the states in use
        queue = [0]
        for s in queue:
            for t in edges[s].values():
                if t not in number:
                    number[t] = len(queue)
                    queue.append(t)
        below = [0] * len(edges)
        for s in _children_first(edges):
            below[s] = int(final[s]) + sum(below[t] for t in edges[s].values())
        key, target, skip = [], [], []
        for s in queue:
            before = int(final[s])
            for c in sorted(edges[s]):
                t = edges[s][c]
                key.append(number[s] * 256 + c)
                target.append(number[t])
                skip.append(before)
                before += below[t]
        flat = [i for k in order for i in ids[k]]
        off = np.zeros(len(order) + 1, np.int64)
        np.cumsum([len(ids[k]) for k in order], out=off[1:])
        return cls(
            {
                "key": np.array(key, np.int64),
                "target": np.array(target, np.int32),
                "skip": np.array(skip, np.int32),
                "final": np.array([final[s] for s in queue], np.bool_),
                "off": off,
                "ids": np.array(flat, np.int32),
            }
        )

    def dump(self) -> bytes:
        """A header line with names, types and places, then the arrays, each at a multiple of 64 bytes."""
        head, at, parts = {}, 0, []
        for n in self.NAMES:
            a = np.ascontiguousarray(getattr(self, n))
            head[n] = (a.dtype.str, a.size, at)
            data = a.tobytes()
            data += b"\0" * (-len(data) % 64)
            parts.append(data)
            at += len(data)
        line = json.dumps(head).encode()
        out = io.BytesIO()
        out.write(line + b" " * (1023 - len(line) % 1024) + b"\n")
        out.writelines(parts)
        return out.getvalue()

    @classmethod
    def map(cls, path: str) -> Lexicon:
        """Memory-maps a dumped lexicon: workers of one machine share its pages."""
        with open(path, "rb") as f:
            line = f.readline()
        head, start = json.loads(line), len(line)
        return cls({n: np.memmap(path, dtype=np.dtype(t), mode="r", offset=start + at, shape=(size,)) if size else np.zeros(0, np.dtype(t)) for n, (t, size, at) in head.items()})

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words step through the automaton together, a byte at a time."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n:
            return out
        lens = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lens) - lens
        live = np.arange(n)
        state = np.zeros(n, np.int64)
        total = np.zeros(n, np.int64)
        depth = 0
        while len(live):
            done = lens[live] == depth
            if done.any():
                ends = live[done]
                ok = self.final[state[ends]]
                out[ends[ok]] = total[ends[ok]]
                live = live[~done]
            if not len(live):
                break
            want = state[live] * 256 + flat[start[live] + depth]
            if not len(self.key):
                break
            at = np.searchsorted(self.key, want)
            at[at == len(self.key)] = 0
            hit = self.key[at] == want
            live, at = live[hit], at[hit]
            state[live] = self.target[at]
            total[live] += self.skip[at]
            depth += 1
        return out


def _children_first(edges: list[dict[int, int]]) -> list[int]:
    """States reachable from 0, each after all its targets."""
    out, seen, stack = [], {0}, [(0, iter(edges[0].values()))]
    while stack:
        s, it = stack[-1]
        t = next(it, None)
        if t is None:
            out.append(s)
            stack.pop()
        elif t not in seen:
            seen.add(t)
            stack.append((t, iter(edges[t].values())))
    return out
