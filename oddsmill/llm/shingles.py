"""Word shingles of a text as sorted distinct 64-bit hashes, and min-hash signatures over them."""

from __future__ import annotations

#: Odd multipliers of the place of a word in a shingle, from the golden ratio and the square roots of 2, 3, 5, 7.
PLACES = (0x9E3779B97F4A7C15, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)


def mix(x):
    """Spreads the bits of uint64 values in place."""
    import numpy as np

    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Shingler:
    """Hashes each distinct word once in a task. Words are cut at space and the ASCII controls tab to carriage return;
    only A-Z is lowered. A text with fewer words than `size` is one shingle, without words it has none."""

    def __init__(self, size: int, most: int = 300_000):
        self.size, self.most, self.memo = size, most, {}

    def words(self, text: str | bytes | None):
        """Hashes of all words, in order."""
        import numpy as np
        import xxhash

        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        found, memo = raw.lower().split(), self.memo
        try:
            return np.array([memo[w] for w in found], np.uint64)
        except KeyError:
            if len(memo) > self.most:
                memo.clear()
            for w in found:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([memo[w] for w in found], np.uint64)

    def grams(self, h):
        """A hash for each run of `size` words."""
        import numpy as np

        n = len(h) - self.size + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(self.size):
            out += h[k : k + n] * np.uint64(PLACES[k])
        return mix(out)

    def __call__(self, text: str | None):
        import numpy as np

        h = self.words(text)
        if 0 < len(h) < self.size:
            short = np.array([len(h)], np.uint64)
            for k in range(len(h)):
                short += h[k : k + 1] * np.uint64(PLACES[k])
            return mix(short)
        return np.unique(self.grams(h))


def signature(shingles, n: int, seed: int = 1):
    """The least of each of n hash orders over a non-empty set, as uint32: sums of products of both halves of a hash."""
    import numpy as np

    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 31, (n, 1), np.uint32) << np.uint32(1) | np.uint32(1) for _ in range(2))
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, (low[None, k : k + 2048] * a + high[None, k : k + 2048] * b).min(1), out=least)
    return least.astype("<u4")
