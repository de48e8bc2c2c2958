"""Induced sorting of the suffixes of a byte string, its queues of suffixes on disk where they outgrow memory."""

from __future__ import annotations

import tempfile


class Queues:
    """First-in first-out queues of suffixes, one for each first byte.

    Suffixes come off in sorted order, so what they induce reaches each queue in sorted order: 256 queues stand in
    for one priority queue. Beyond `most` entries in memory the runs are written to a file of the task.
    """

    def __init__(self, most: int):
        self.most, self.held, self.file = most, 0, None
        self.runs: list[list] = [[] for _ in range(256)]

    def push(self, c: int, suffixes) -> None:
        self.runs[c].append(suffixes)
        self.held += len(suffixes)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        import numpy as np

        self.file = self.file or tempfile.TemporaryFile()
        for c, runs in enumerate(self.runs):
            fresh = [r for r in runs if not isinstance(r, tuple)]
            if fresh:
                run = np.concatenate(fresh)
                at = self.file.seek(0, 2)
                self.file.write(run.tobytes())
                self.runs[c] = [r for r in runs if isinstance(r, tuple)] + [(at, len(run), run.dtype)]
        self.held = 0

    def take(self, c: int):
        """All that queue c holds, in order; the queue is empty then."""
        import numpy as np

        out = []
        for r in self.runs[c]:
            if isinstance(r, tuple):
                at, n, dtype = r
                self.file.seek(at)
                out.append(np.frombuffer(self.file.read(n * dtype.itemsize), dtype))
            else:
                out.append(r)
                self.held -= len(r)
        self.runs[c] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def _types(text):
    """Which suffixes are smaller than their successor."""
    import numpy as np

    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    changed = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(changed[::-1])[::-1]
    return step[following] > 0


def _deal(queues: Queues, text, suffixes) -> None:
    import numpy as np

    if len(suffixes):
        c = text[suffixes]
        order = np.argsort(c, kind="stable")
        ends = np.cumsum(np.bincount(c, minlength=256))
        for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            queues.push(k, suffixes[order[ends[k - 1] if k else 0 : ends[k]]])


def _induce(text, small, seeds, most: int):
    """All suffixes in order, from the left-most small ones in order: larger ones upwards, then smaller ones downwards."""
    import numpy as np

    n = len(text)
    marked, up = Queues(most), Queues(most)
    _deal(marked, text, seeds)
    up.push(int(text[-1]), np.array([n - 1], seeds.dtype))
    large: list = [None] * 256
    for c in range(256):
        got, run = [], up.take(c)
        while len(run):
            got.append(run)
            before = run[run > 0] - 1
            before = before[~small[before]]
            same = text[before] == c
            _deal(up, text, before[~same])
            run = before[same]
        large[c] = np.concatenate(got) if got else np.zeros(0, seeds.dtype)
        run = marked.take(c)
        before = run[run > 0] - 1
        _deal(up, text, before[~small[before]])
    down, out = Queues(most), []
    for c in range(255, -1, -1):
        got, run = [], down.take(c)
        while len(run):
            got.append(run)
            before = run[run > 0] - 1
            before = before[small[before]]
            same = text[before] == c
            _deal(down, text, before[~same])
            run = before[same]
        run = large[c][::-1]
        before = run[run > 0] - 1
        _deal(down, text, before[small[before]])
        out += [*got, run]
    return np.concatenate(out)[::-1]


def _names(text, ends, starts_in_order):
    """Names of the pieces between left-most small suffixes, alike for alike pieces, in their order."""
    import numpy as np

    length = ends[starts_in_order] - starts_in_order + 1
    fresh = np.ones(len(starts_in_order), bool)
    fresh[1:] = length[1:] != length[:-1]
    same = np.flatnonzero(~fresh)
    depth = 0
    while len(same):  # pieces of equal length byte by byte, as long as they agree
        a, b = starts_in_order[same], starts_in_order[same - 1]
        differ = text[a + depth] != text[b + depth]
        fresh[same[differ]] = True
        depth += 1
        same = same[~differ & (length[same] > depth)]
    return np.cumsum(fresh) - 1


def _order(names, depth: int):
    """Order of the suffixes of a string of names by their first `depth` names or more: ranks over doubling lengths."""
    import numpy as np

    rank, k = names.astype(np.int64), 1
    while True:
        follow = np.zeros(len(rank), np.int64)
        follow[:-k] = rank[k:] + 1
        key = rank * (len(rank) + 2) + follow
        order = np.argsort(key, kind="stable")
        k *= 2
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if k >= depth or k >= len(rank) or fresh[-1] == len(rank) - 1:
            return order
        rank[order] = fresh


def suffix_array(text, depth: int, most: int = 1 << 24):
    """Starts of all suffixes of a byte array, in the order of their first `depth` bytes or more.

    Left-most small suffixes are sorted first: one induction sorts the pieces between them, the string of the
    pieces' names is sorted (each name is two bytes or more, so depth / 2 names settle it), and a second induction
    gives the order to all suffixes. Queues hold at most `most` suffixes in memory and go to disk beyond.
    """
    import numpy as np

    text = np.asarray(text, np.uint8)
    if len(text) < 2:
        return np.arange(len(text))
    small = _types(text)
    seeds = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32 if len(text) < 1 << 31 else np.int64)
    if len(seeds) > 1:
        order = _induce(text, small, seeds, most)
        is_seed = np.zeros(len(text), bool)
        is_seed[seeds] = True
        order = order[is_seed[order]]
        ends = np.zeros(len(text), seeds.dtype)
        ends[seeds] = np.append(seeds[1:], len(text) - 1)
        names = np.zeros(len(text), seeds.dtype)
        names[order] = _names(text, ends, order)
        seeds = seeds[_order(names[seeds], depth // 2 + 2)]
    return _induce(text, small, seeds, most)
