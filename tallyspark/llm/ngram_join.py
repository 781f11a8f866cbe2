"""Self join of texts on the Jaccard similarity of their word n-grams, by prefix trees.

A set's n-grams are put in one global order: n-grams that repeat within blocks of the corpus come last, by
their counted frequency, all others by hash. Two sets that reach the threshold t share an n-gram among the
first |x| - ceil(t |x|) + 1 of each, and r of them if r - 1 more are taken; so sets that share fewer with all
others of fitting size never meet. Sets that meet by an n-gram make a run, in which a signature of each set's
n-grams (the parity of those with each hash) bounds the difference of two sets from below: only sets that the
bound lets link, directly or through others, make a block. Blocks are stored in a prefix tree. A set walks those
paths of the tree that hold sets which share one of its first n-grams, with the overlap so far, and a subtree is
left when overlap and the rest of the shorter side can't reach the threshold. What is already connected is not
compared again. A block too large for a task is cut into what met under one leader, and that, if need be, into
pairs of parts; an n-gram with more than HOT sets is dealt out by pairs of parts likewise.

Exact copies of a set are one node. The order only steers the work: links don't depend on it. N-grams are told
apart by 64-bit hashes, sets by 128-bit ones.

Defined results: null, empty and blank texts have the empty set, which links with nothing; a text of fewer than
n words is one n-gram; rows without an id are returned unlinked, with a null component; repeated ids and rows
are linked row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, release, releasing, ship, table
from tallyspark.llm.components import components

#: Repeating n-grams of which the order holds the frequency: the most frequent ones, 16 bytes each.
FREQUENT = 65_536
#: N-grams that are counted together before those met once are let go.
BLOCK = 2_000_000
#: N-grams of all sets that one task compares; larger runs are dealt out by pairs of parts.
TASK = 6_000_000
#: Ids that are broadcast at most, of 8 or 16 bytes each.
SMALL = 200_000
#: Sets of an n-gram that meet in one place; those of more frequent n-grams meet by pairs of parts.
HOT = 250_000
#: Bits of a set's signature.
BITS = 512
#: Sets of a run that are compared row by row, and rows whose runs are brought together before they are handed on.
FEW, ROWS = 16, 500_000
#: Longer words are hashed one by one.
WORD = 64


#: Bytes of text that are hashed at once.
_PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(2024).integers(0, 1 << 64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, _PIECE), _powers(pow(_P, -1, 1 << 64), _PIECE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data, which ends with a space: sums of powers, by differences of running sums."""
    starts_, hashes = [], []
    at = 0
    while at < len(data):
        to = min(len(data), at + _PIECE)
        if to < len(data):
            space = data.rfind(b" ", at, to)
            to = space + 1 if space >= 0 else data.index(b" ", to) + 1
        piece = np.frombuffer(data, np.uint8, to - at, at)
        space = _SPACE[piece]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        n = len(piece)
        up, down = (_UP, _DOWN) if n <= _PIECE else (_powers(_P, n), _powers(pow(_P, -1, 1 << 64), n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[piece] * up[:n], out=sums[1:])
        h = _mix((sums[ends] - sums[starts]) * down[starts])
        for k in np.flatnonzero(ends - starts > WORD).tolist():  # sums of powers of long words can be made to collide
            h[k] = xxhash.xxh3_64_intdigest(piece[starts[k] : ends[k]].tobytes())
        hashes.append(h)
        starts_.append(starts + at)
        at = to
    return np.concatenate(starts_), np.concatenate(hashes)


def ngram_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct word n-grams."""
    if not texts:
        return []
    # of bytes: lower() changes A-Z only
    encoded = [(t or "").encode().lower() for t in texts]
    begin = np.cumsum([0] + [len(e) + 1 for e in encoded])
    start, h = _words(b" ".join(encoded) + b" ")
    first = np.searchsorted(start, begin)  # of each text's words
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    grams = np.empty(0, np.uint64)
    if len(h) >= n:
        grams = _grams(h, n)
        grams = grams[of[: len(grams)] == of[n - 1 :]]
    words = np.diff(first)
    last = np.cumsum(np.maximum(words - n + 1, 0))
    out = []
    for k, m in enumerate(words.tolist()):
        if m >= n:
            some = np.sort(grams[last[k] - m + n - 1 : last[k]])  # np.unique takes three times as long
            out.append(some[np.append(True, some[1:] != some[:-1])])
        else:
            out.append(_grams(h[first[k] : first[k] + m], m) if m else np.empty(0, np.uint64))
    return out


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = (x ^ h[i : len(h) - n + 1 + i]) * np.uint64(_P)
        x ^= x >> np.uint64(29)
    return _mix(x)


def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    return ngram_sets([text], n)[0]


def set_id(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def short(s: bytes) -> int:
    """As xxhash64 of a binary column. Sets that agree here by chance meet more often than they need to, no more."""
    h = xxhash.xxh64_intdigest(s, 42)
    return h - (1 << 64) if h >> 63 else h


def signature(tokens: np.ndarray) -> bytes:
    """Of each hash of BITS, whether an odd number of n-grams has it: two sets differ by as many n-grams, at least, as bits."""
    return np.packbits(np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def more(n: int) -> int:
    """How many n-grams, at least, a set of n shares with a set of its size or more that it links with, among their first ones.

    The first n - need(n) + more(n) are taken: what they leave out is more(n) less than any overlap, so that
    many of the overlap are among them; and as all sets follow one order, those are the first of the overlap
    for both sets of a pair, which share the smaller set's number at least.
    """
    return 1 + n // 20


def taken(n: int, percent: int) -> int:
    return min(n, n - need(n, percent) + more(n))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Order:
    """The global order: by (counted frequency, hash)."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def sort(self, tokens: np.ndarray) -> np.ndarray:
        """tokens are sorted by hash."""
        if not len(self.tokens) or not len(tokens):
            return tokens
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        hit = self.tokens[at] == tokens
        if not hit.any():
            return tokens
        late = np.argsort(self.counts[at[hit]], kind="stable")
        return np.concatenate([tokens[~hit], tokens[hit][late]])

    def parts(self, tokens: np.ndarray) -> np.ndarray:
        """In how many parts the sets of each n-gram are dealt out."""
        if not len(self.tokens):
            return np.ones(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, -(-self.counts[at] // HOT), 1)

    def hottest(self) -> int:
        return int(self.counts.max(initial=0))


_SKETCH = {"kind": pa.int8(), "id": pa.int64(), "t": pa.int64(), "n": pa.int64(), "s": pa.binary(), "sig": pa.binary(), "token": pa.int64()}


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0: id, t, size, set, signature) and of repeating n-grams (kind 1: n-gram, count). Batches have id, t, text."""
    held: list[np.ndarray] = []
    size = 0

    def made(rows: int, **cols) -> pa.RecordBatch:
        arrays = [cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], k) if c in cols else pa.nulls(rows, k) for c, k in _SKETCH.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(_SKETCH))

    def repeated() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        return made(len(tokens), kind=np.ones(len(tokens), np.int8), token=_longs(tokens), n=counts)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sizes, sets, sigs = [], [], []
            for tokens in ngram_sets(part.column(2).to_pylist(), n):
                sizes.append(len(tokens))
                sets.append(set_id(tokens) if len(tokens) else None)
                sigs.append(signature(tokens) if len(tokens) else None)
                held.append(tokens)
                size += len(tokens)
                if size >= BLOCK:
                    yield repeated()
                    held, size = [], 0
            yield made(part.num_rows, kind=np.zeros(part.num_rows, np.int8), id=part.column(0), t=part.column(1), n=sizes, s=sets, sig=sigs)
    if held:
        yield repeated()


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, order: Order) -> Iterator[pa.RecordBatch]:
    """token, s, n: the first n-grams of each set, once for all copies that a task meets; s is a set's short number."""
    seen: set[int] = set()
    hottest = order.hottest() > HOT
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            tokens_, sets, sizes, times = [], [], [], []
            for tokens in ngram_sets(batch.column(0).slice(at, 1024).to_pylist(), n):
                if not len(tokens) or (s := short(set_id(tokens))) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(s)
                first = order.sort(tokens)[: taken(len(tokens), percent)]
                # part p of a hot n-gram's sets goes to the places (p, q) and (q, p)
                if hottest and (hot := (parts := order.parts(first)) > 1).any():
                    cells = [first[~hot]]
                    for token, k in zip(first[hot].tolist(), parts[hot].tolist(), strict=True):
                        q = np.arange(k, dtype=np.uint64)
                        p = np.uint64(s % k)
                        cells.append(_mix(np.uint64(token) ^ _mix(np.minimum(p, q) * np.uint64(k) + np.maximum(p, q) + np.uint64(1))))
                    first = np.concatenate(cells)
                tokens_.append(first)
                sets.append(s)
                sizes.append(len(tokens))
                times.append(len(first))
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [_longs(np.concatenate(tokens_)), pa.array(np.repeat(np.array(sets, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int32), times))],
                    names=["token", "s", "n"],
                )


def _whole(batches: Iterator[pa.RecordBatch], cols: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut only where that changes; rows of one value are held together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(cols)]
        if held and held[-1][0][-1] == now[0][-1]:
            held.append(now)  # still within one run
            continue
        held.append(now)
        every = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = int(np.searchsorted(every[0], every[0][-1]))
        held = [[x[last:] for x in every]]
        if last:
            yield [x[:last] for x in every]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _runs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """run, s, c from rows sorted by token, size and set: the sets of each run that sizes let link, and of how many n-grams.

    A run is named by its sets, so that n-grams of the same sets make one.
    """
    for token, s, n in _whole(batches, 3):
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (s[1:] != s[:-1])
        token, s, n = token[once], s[once], n[once].astype(np.int64)
        # a run ends where the token changes, or where sizes are too far apart for any pair across to link
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(token)))
        many = lengths > 1
        if not many.any():
            continue
        name = np.add.reduceat(_mix(s.view(np.uint64)), starts).view(np.int64)
        row = np.repeat(many, lengths)
        frame = pd.DataFrame({"run": np.repeat(name, lengths)[row], "s": s[row], "c": 1}).groupby(["run", "s"], sort=False, as_index=False)["c"].sum()
        yield pa.RecordBatch.from_arrays([pa.array(frame[c].to_numpy(), pa.int64()) for c in ("run", "s", "c")], names=["run", "s", "c"])


def _possible(na, nb, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and signatures let sets link: their bits differ in no more places than linked sets can."""
    total = na + nb
    most = total - 2 * -(-percent * total // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= most)


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """leader, node from rows sorted by run and size (run, node, size, signature): what signatures let link, directly or through others."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def union(pairs_a: np.ndarray, pairs_b: np.ndarray) -> None:
        for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)

    def found() -> pa.RecordBatch:
        nodes = np.array(list(up), np.int64)
        return pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes.tolist()], pa.int64()), pa.array(nodes)], names=["leader", "node"])

    for run, node, n, sig in _whole(batches, 4):
        sig = np.frombuffer(b"".join(sig.tolist()), np.uint64).reshape(len(run), BITS // 64)
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        lengths = np.diff(np.append(starts, len(run)))
        for d in range(1, FEW):  # of small runs all at once, rows so many places apart
            i = np.flatnonzero((run[d:] == run[:-d]) & (np.repeat(lengths, lengths)[d:] <= FEW))
            if not len(i):
                break
            i = i[_possible(n[i], n[i + d], sig[i], sig[i + d], percent)]
            union(node[i], node[i + d])
        for a, m in zip(starts[lengths > FEW].tolist(), lengths[lengths > FEW].tolist(), strict=True):
            left = np.arange(a, a + m)
            while len(left):
                todo, left = [int(left[0])], left[1:]
                while todo and len(left):
                    v = todo.pop()
                    fit = slice(np.searchsorted(n[left], -(-percent * n[v] // 100)), np.searchsorted(n[left], 100 * n[v] // percent, "right"))
                    hit = np.zeros(len(left), bool)
                    hit[fit] = _possible(n[v], n[left[fit]], sig[v], sig[left[fit]], percent)
                    if hit.any():
                        union(np.full(int(hit.sum()), node[v]), node[left[hit]])
                        todo += left[hit].tolist()
                        left = left[~hit]
        if len(up) > ROWS:
            yield found()
            up.clear()
    if up:
        yield found()


class Tree:
    """A prefix tree with compressed edges over sets, given as sorted arrays of one order's ranks (0 to universe - 1).

    Nodes are kept by level, so that a walk takes a level's nodes at once: `tokens` has their edges one after the
    other. Leaves are the sets; a set that is the beginning of another ends at a leaf of its own without tokens.
    """

    def __init__(self, sets: list[np.ndarray], universe: int):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">i4").tobytes())
        self.mark = np.zeros(universe, bool)
        # nodes as they are found along the sorted sets: (parent, depth above, depth, set, first token's place)
        parent, above, depth, of = [-1], [0], [0], [0]
        leaf = [-1]
        path = [0]
        before: np.ndarray | None = None
        for k in order:
            x, same = sets[k], 0
            if before is not None:
                m = min(len(before), len(x))
                differ = np.flatnonzero(before[:m] != x[:m])
                same = int(differ[0]) if len(differ) else m
            last = -1
            while depth[path[-1]] > same or leaf[path[-1]] >= 0:
                last = path.pop()
            if depth[path[-1]] < same:  # the edge is split where the sets part
                parent.append(path[-1])
                above.append(depth[path[-1]])
                depth.append(same)
                of.append(k)
                leaf.append(-1)
                parent[last], above[last] = len(parent) - 1, same
                path.append(len(parent) - 1)
            parent.append(path[-1])
            above.append(depth[path[-1]])
            depth.append(len(x))
            of.append(k)
            leaf.append(k)
            path.append(len(parent) - 1)
            before = x
        up, leaf_ = np.array(parent), np.array(leaf)
        level = np.zeros(len(up), np.int64)
        at = up.copy()
        while (at >= 0).any():
            level[at >= 0] += 1
            at = np.where(at >= 0, up[at], -1)
        by = np.argsort(level, kind="stable")  # nodes are numbered by level from here on
        number = np.empty_like(by)
        number[by] = np.arange(len(by))
        level = level[by]
        self.up = np.where(up[by] >= 0, number[up[by]], -1)
        self.leaf = leaf_[by]
        self.starts = np.searchsorted(level, np.arange(int(level[-1]) + 2))
        self.node_of = np.empty(len(sets), np.int64)
        self.node_of[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)
        sizes = np.array([len(x) for x in sets])
        self.shortest = np.where(self.leaf >= 0, sizes[self.leaf], 1 << 40)
        self.longest = np.where(self.leaf >= 0, sizes[self.leaf], 0)
        for k in range(len(self.starts) - 2, 0, -1):
            here = slice(self.starts[k], self.starts[k + 1])
            np.minimum.at(self.shortest, self.up[here], self.shortest[here])
            np.maximum.at(self.longest, self.up[here], self.longest[here])
        edges = [sets[of[v]][above[v] : depth[v]] if v else sets[0][:0] for v in by.tolist()]
        self.size = np.array([len(e) for e in edges])
        self.first = np.cumsum(self.size) - self.size
        self.tokens = np.concatenate(edges)
        self.ends = np.array([int(e[-1]) if len(e) else -1 for e in edges])
        self.depth = np.array(depth)[by]
        self.overlap = np.zeros(len(by), np.int64)
        self.alive, self.on = np.zeros(len(by), bool), np.zeros(len(by), bool)
        self.on[0] = True

    def links(self, x: np.ndarray, percent: int, leaves: np.ndarray) -> np.ndarray:
        """Those of the given sets that have percent of the union with x in common."""
        n, out = len(x), []
        at = self.node_of[leaves]
        if 8 * len(at) > len(self.up):
            chosen = np.arange(len(self.up))
        else:
            while len(at):
                self.on[at] = True
                at = self.up[at]
                at = at[~self.on[at]]
            chosen = np.flatnonzero(self.on)
            self.on[chosen] = False
            self.on[0] = True
        self.mark[x] = True
        self.alive[chosen] = False
        self.alive[0], self.overlap[0] = True, 0
        cuts = np.searchsorted(chosen, self.starts)
        for k in range(1, len(self.starts) - 1):
            go = chosen[cuts[k] : cuts[k + 1]]
            if not len(go):
                break
            low, high = np.maximum(self.shortest[go], need(n, percent)), np.minimum(self.longest[go], 100 * n // percent)
            some = self.alive[self.up[go]] & (low <= high)
            go, low, high = go[some], low[some], high[some]
            if not len(go):
                break
            # the overlap along each edge, from a running count over the edges' tokens
            sizes, first = self.size[go], self.first[go]
            span = int(first[-1] + sizes[-1] - first[0])
            total = int(sizes.sum())
            if 2 * total > span:
                to = first - first[0] + sizes
                some_tokens = self.tokens[first[0] : first[0] + span]
            else:
                to = np.cumsum(sizes)
                some_tokens = self.tokens[np.repeat(first - (to - sizes), sizes) + np.arange(total)]
            count = np.zeros(len(some_tokens) + 1, np.int32)
            np.cumsum(self.mark[some_tokens], dtype=np.int32, out=count[1:])
            so_far = self.overlap[self.up[go]] + count[to] - count[to - sizes]
            self.overlap[go] = so_far
            done, depth = self.leaf[go] >= 0, self.depth[go]
            hit = done & (100 * so_far >= percent * (n + depth - so_far))
            out.append(self.leaf[go[hit]])
            left = np.minimum(n - np.searchsorted(x, self.ends[go], "right"), high - depth)
            least = -(-percent * (n + low) // (100 + percent))
            self.alive[go[~done & (so_far + left >= least)]] = True
        self.mark[x] = False
        return np.concatenate(out) if out else np.empty(0, np.int64)


def local_links(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each of distinct sets (sorted arrays of one order's ranks), the first set that it is connected with."""
    if len(sets) < 2:
        return list(range(len(sets)))
    universe = 1 + max((int(x[-1]) for x in sets if len(x)), default=0)
    tree = Tree(sets, universe)
    # by each n-gram, the sets that have it among their first ones: only those can link
    firsts = [x[: taken(len(x), percent)] for x in sets]
    holder = np.repeat(np.arange(len(sets)), [len(f) for f in firsts])
    gram = np.concatenate(firsts)
    by = np.argsort(gram, kind="stable")
    holder = holder[by]
    begin = np.searchsorted(gram[by], np.arange(universe + 1))
    sizes = np.array([len(x) for x in sets])
    root = np.arange(len(sets))
    members = {k: [k] for k in range(len(sets))}
    done = np.zeros(universe, bool)  # n-grams all of whose sets are connected
    for k, x in enumerate(sets):
        first = firsts[k][~done[firsts[k]]]
        if not len(first):
            continue
        a, n = begin[first], begin[first + 1] - begin[first]
        to = np.cumsum(n)
        met = holder[np.repeat(a - (to - n), n) + np.arange(int(to[-1]))]
        others = met[(met > k) & (root[met] != root[k])]  # each pair is met from its first set
        others = np.unique(others[(100 * sizes[others] >= percent * len(x)) & (100 * len(x) >= percent * sizes[others])])
        if len(others):
            hit = np.unique(root[tree.links(x, percent, others)])
            for other in hit[hit != root[k]].tolist():
                large, small = int(root[k]), other
                if len(members[large]) < len(members[small]):
                    large, small = small, large
                root[members[small]] = large
                members[large] += members.pop(small)
        same = np.maximum.reduceat(root[met], to - n) == np.minimum.reduceat(root[met], to - n)
        done[first[same]] = True
    least = {r: min(m) for r, m in members.items()}
    return [least[r] for r in root.tolist()]


def _compare(pdf: pd.DataFrame, n: int, percent: int, order: Order) -> pd.DataFrame:
    """a, b: pairs of nodes that connect what links among the sets of pdf (node, s, text). Texts of other sets of an id are left out."""
    distinct: dict[int, np.ndarray] = {}
    for at in range(0, len(pdf), 1024):
        part = pdf.iloc[at : at + 1024]
        for node, s, tokens in zip(part["node"].tolist(), part["s"].tolist(), ngram_sets(part["text"].tolist(), n), strict=True):
            if node not in distinct and set_id(tokens) == s:
                distinct[node] = tokens
    if len(distinct) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    ids = sorted(distinct)
    every = order.sort(np.unique(np.concatenate([distinct[i] for i in ids])))
    by = np.argsort(every)
    place = every[by]
    ranks = [np.sort(by[np.searchsorted(place, distinct[i])]).astype(np.int32) for i in ids]
    roots = local_links(ranks, percent)
    pairs = [(ids[k], ids[r]) for k, r in enumerate(roots) if k != r]
    return pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, dtype="int64")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def linked(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, t (text_key), n, s, root, component_id of each row of docs (id long, text); sets that are linked have one root."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("id", text_key(F.col("text")).alias("t"), "text")
    first = cut(docs.mapInArrow(lambda it: releasing(_sketch(it, n)), "kind byte, id long, t long, n long, s binary, sig binary, token long"))
    rows = first.where("kind = 0").select("id", "t", "n", "s")
    often = first.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).where("n > 3").orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    order = spark.sparkContext.broadcast(  # FREQUENT entries at most
        Order(np.array([r["token"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64))
    )
    entries = docs.where("id is not null").select("text").mapInArrow(lambda it: releasing(_prefixes(it, n, percent, order.value)), "token long, s long, n int")
    runs = entries.repartition("token").sortWithinPartitions("token", "n", "s").mapInArrow(lambda it: releasing(_runs(it, percent)), "run long, s long, c long")
    runs = cut(runs.groupBy("run", "s").agg(F.sum("c").alias("c")))
    sets = first.where("kind = 0 and s is not null and id is not null").groupBy("s").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    heads = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    # only sets that share so many of their first n-grams with others can link
    least = F.least(F.lit(1) + F.floor(F.col("n") / 20), F.ceil(F.col("n") * percent / 100))
    met = runs.groupBy("s").agg(F.sum("c").alias("c")).withColumnRenamed("s", "short")
    likely = cut(heads.join(met, F.xxhash64("s") == F.col("short")).where(F.col("c") >= least).select("short", "node", "s", "id", "n", "sig"))
    rows_of_runs = runs.select("run", F.col("s").alias("short")).join(likely.select("short", "node", "n", "sig"), "short").select("run", "node", "n", "sig")
    near = rows_of_runs.repartition("run").sortWithinPartitions("run", "n", "node").mapInArrow(lambda it: releasing(_near(it, percent)), "leader long, node long")
    groups = cut(near.distinct())
    # a block that fits a task is compared there, with others that fit beside it; of larger ones, what met under each leader
    blocks = components(groups, "leader", "node").select("node", F.col("root").alias("block"))
    sized = cut(blocks.join(likely.select("node", "s", "id", "n"), "node"))
    totals = cut(sized.groupBy("block").agg(F.sum("n").alias("total")))
    large = totals.where(F.col("total") > TASK).select("block")
    bins = 1 + (totals.where(F.col("total") <= TASK).agg(F.sum("total").alias("n")).collect()[0]["n"] or 0) // (TASK // 8)
    place = F.pmod(F.xxhash64("block"), F.lit(bins)).alias("leader")
    small = sized.join(large, "block", "left_anti").select(place, F.lit(-1).alias("i"), F.lit(-1).alias("j"), "node", "s", "id")
    rest = groups.join(sized.join(large, "block", "left_semi"), "node")
    weights = rest.groupBy("leader").agg(F.ceil(F.sum("n") / TASK).cast("int").alias("k"))
    part = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")  # part p meets part q, for each p <= q
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j"))))
    rest = rest.join(weights, "leader").withColumn("p", part).withColumn("cell", cells).select("leader", "cell.i", "cell.j", "node", "s", "id")
    members = cut(small.unionByName(rest))
    wanted = members.select("id").distinct()
    texts = docs.select("id", "text").join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted, "id", "left_semi")
    pairs = members.join(texts, "id").select("leader", "i", "j", "node", "s", "text")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return _compare(pdf, n, percent, order.value)
        finally:
            release()

    edges = cut(pairs.groupBy("leader", "i", "j").applyInPandas(compare, "a long, b long"))
    found = components(edges)
    # a component is named by its smallest id; sets that link with no other keep their own rows' smallest id
    named = heads.select("s", "id", "node").join(found, "node", "left").select("s", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select("s", "root", "component_id")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.join(named, "s", "left").select("id", "t", "n", "s", "root", component.alias("component_id"))


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of each row of docs; component_id: the smallest id reachable by links."""
    out = linked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: one of those with its smallest doc_id. Rows without an id or words stay.

    Rows are told apart by id and text, so that unlinked texts of one id stay all.
    """
    found = linked(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), n, percent).where("id is not null and s is not null")
    found = cut(found.groupBy("root", "id", "t").agg(F.count("*").alias("times")))
    first = found.groupBy("root").agg(F.min(F.struct("id", "t")).alias("first"))
    told = found.join(first, "root").select(F.col("id").alias("__id"), F.col("t").alias("__t"), (F.struct("id", "t") == F.col("first")).alias("__first"), "times")
    told = cut(told.where("not __first or times > 1").select("__id", "__t", "__first"))
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (text_key(F.col("text")) == F.col("__t"))
    told = F.broadcast(told) if told.count() <= SMALL else told
    rest = docs.join(told, same, "left_anti")
    # repeated rows of a document that stays: one of them, chosen by all columns
    names = [F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    again = docs.join(told.where("__first"), same).select("__id", "__t", F.struct(*names).alias("row"))
    again = again.groupBy("__id", "__t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rest.unionByName(again.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as t from s),
l as (select a.doc_id as a, b.doc_id as b from e a join e b on a.t = b.t and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
      having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as low from r group by a)
select cast(s.doc_id as bigint) as doc_id, cast(len(s.sh) as bigint) as n_shingles, cast(least(s.doc_id, coalesce(c.low, s.doc_id)) as bigint) as component_id
from s left join c on c.a = s.doc_id
"""
