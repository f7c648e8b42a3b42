"""Planning a substring scan: a set of codes of which every row that holds the pattern has at least one.

Offsets of the pattern are nodes. However an occurrence is tokenized, its tokens trace a way from the start to the end: a token that
reaches into the occurrence from before leads from 0 to where it ends; inside, the greedy token leads on; a token that reaches the
end or beyond leads to the end. A set of edges that cuts all ways names the codes to probe for; the cheapest cut by token
frequency is where the greatest flow is held up.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from stringloom.config import MAX_TOKEN
from stringloom.errors import FrequencyIndexMismatch, MissingByteToken, PatternTooLong
from stringloom.functions.dictionary import Dictionary

MAX_PATTERN = 65_535
AUTOMATON_PATTERN = 255
#: Overlap sets larger than this aren't listed and are never cut: a cover of so many codes would hit most rows, and the automaton is cheaper.
MOST_LISTED = 1024
#: Codes of a cover up to which the JVM probes by one hash set; beyond, its ranges are compared one by one.
SET_CODES = 4096


@dataclass(frozen=True)
class Costs:
    """Nanoseconds on one core, measured (arrays: `python -m stringloom.plans.measure`; with Spark: transfer of packed rows 17 a code); only
    their ratios matter for a choice.

    code: moving a code to Python and looking it up in the table of the cover; hit: verifying a hit by its neighbourhood, and for each byte
    of the pattern; live, step: moving a code and looking it up in the automaton's table, and following a live one; decode: moving and
    decoding a code of a whole row; native, range: a code in the JVM's hash set, and for each range that is too wide for the set.
    """

    code: float = 23.0
    hit: float = 1500.0
    hit_byte: float = 20.0
    live: float = 24.0
    step: float = 220.0
    decode: float = 34.0
    native: float = 8.0
    range: float = 12.0


COSTS = Costs()


@dataclass
class Edge:
    start: int
    end: int
    runs: list[tuple[int, int]] | None  # inclusive code ranges; None: not listed, can't be cut
    kind: str

    def hits(self, prefix: list[int]) -> float:
        return sum(prefix[b + 1] - prefix[a] for a, b in self.runs)

    def cost(self, prefix: list[int] | None, point: float, range_: float) -> float:
        """Expected hits, and the price of the tests in hits."""
        if self.runs is None:
            return float("inf")
        return (self.hits(prefix) if prefix is not None else 0) + sum(point if a == b else range_ for a, b in self.runs)


@dataclass
class Cover:
    """Disjoint, sorted: single codes and inclusive ranges of codes."""

    points: list[int] = field(default_factory=list)
    ranges: list[tuple[int, int]] = field(default_factory=list)

    @staticmethod
    def of(runs: list[tuple[int, int]]) -> Cover:
        merged: list[list[int]] = []
        for a, b in sorted(r for r in runs if r[0] <= r[1]):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return Cover([a for a, b in merged if a == b], [(a, b) for a, b in merged if a < b])

    def __contains__(self, code: int) -> bool:
        return code in self.points or any(a <= code <= b for a, b in self.ranges)

    def codes(self) -> list[int]:
        """Its codes, one by one."""
        return sorted([*self.points, *(c for a, b in self.ranges for c in range(a, b + 1))])

    def hits(self, prefix: list[int]) -> int:
        return sum(prefix[p + 1] - prefix[p] for p in self.points) + sum(prefix[b + 1] - prefix[a] for a, b in self.ranges)


def edges_of(pattern: bytes, dictionary: Dictionary) -> list[Edge]:
    n = len(pattern)
    edges: list[Edge] = []
    starts = {0}
    ends_with: dict[bytes, list[int]] = {}
    for i, t in enumerate(dictionary.tokens):
        for k in range(1, min(len(t), n)):
            if t[-k:] == pattern[:k]:
                ends_with.setdefault(pattern[:k], []).append(i)
    for k in range(1, min(n, MAX_TOKEN)):
        codes = ends_with.get(pattern[:k], [])
        if codes:
            edges.append(Edge(0, k, [(c, c) for c in codes] if len(codes) <= MOST_LISTED else None, "overlap"))
            starts.add(k)
    if n <= MAX_TOKEN:
        inside = [i for i, t in enumerate(dictionary.tokens) if t.find(pattern, 1) > 0 and not t.startswith(pattern)]
        if inside:
            edges.append(Edge(0, n, [(c, c) for c in inside] if len(inside) <= MOST_LISTED else None, "contained"))
    built: set[int] = set()
    todo = sorted(starts)
    while todo:
        at = todo.pop()
        if at in built:
            continue
        built.add(at)
        best, beyond = dictionary.longest_prefix(pattern[at : at + MAX_TOKEN])
        if best is None:
            raise MissingByteToken(pattern[at])
        if n - at <= MAX_TOKEN and not beyond.empty:
            edges.append(Edge(at, n, [(beyond.begin, beyond.last)], "end"))
        to = at + dictionary.token_len(best)
        if to < n:
            edges.append(Edge(at, to, [(best, best)], "greedy"))
            todo.append(to)
    return edges


def least_cut(edges: list[Edge], n: int, prefix: list[int] | None, point: float, range_: float) -> list[Edge]:
    """Edges of least total cost that cut every way from 0 to n; of equally cheap cuts the one nearest to the start.

    Shortest augmenting ways: only the last 16 offsets lead to the end, so there are few ways to add.
    """
    room = [e.cost(prefix, point, range_) for e in edges] + [0.0] * len(edges)  # edge i backwards is i + len(edges)
    m = len(edges)
    ends = [e.end for e in edges] + [e.start for e in edges]
    leaving: dict[int, list[int]] = {}
    for i, e in enumerate(edges):
        leaving.setdefault(e.start, []).append(i)
        leaving.setdefault(e.end, []).append(i + m)
    while True:
        came: dict[int, int] = {0: -1}
        line = [0]
        for node in line:
            if n in came:
                break
            for i in leaving.get(node, ()):
                if room[i] > 1e-9 and ends[i] not in came:
                    came[ends[i]] = i
                    line.append(ends[i])
        if n not in came:
            return [e for e in edges if e.start in came and e.end not in came]
        way, node = [], n
        while node:
            way.append(came[node])
            node = ends[(came[node] + m) % (2 * m)]
        least = min(room[i] for i in way)
        if least == float("inf"):
            raise ValueError("no cut: edges that aren't listed lead straight to the end")
        for i in way:
            room[i] -= least
            room[(i + m) % (2 * m)] += least


@dataclass
class Way:
    """One way to scan: `table` and `native` probe for a cover and verify the hits, `automaton` follows every row, `decode` decodes every row."""

    kind: str
    cost: float  # nanoseconds a code
    cut: list[Edge] = field(default_factory=list)
    cover: Cover | None = None


class Scan:
    """A prepared substring search: `cover` is None for the empty pattern, which every row holds.

    `ways` are all that were priced, the cheapest first; `way` is the one taken.
    """

    def __init__(self, pattern: bytes, dictionary: Dictionary, prefix: list[int] | None, costs: Costs = COSTS):
        """prefix: cumulative token counts (one more than tokens); None plans as if all tokens were equally frequent."""
        if len(pattern) > MAX_PATTERN:
            raise PatternTooLong(len(pattern), MAX_PATTERN)
        if prefix is not None and len(prefix) != dictionary.num_tokens + 1:
            raise FrequencyIndexMismatch(max(0, len(prefix) - 1), dictionary.num_tokens)
        self.pattern, self.dictionary = pattern, dictionary
        self.cover: Cover | None = None
        self.edges: list[Edge] = []
        self.cut: list[Edge] = []
        self.ways: list[Way] = []
        self.whole = False
        if not pattern:
            return
        self.edges = edges_of(pattern, dictionary)
        counts = prefix if prefix is not None and prefix[-1] else list(range(dictionary.num_tokens + 1))
        total = counts[-1]
        verify = costs.hit + costs.hit_byte * len(pattern)
        try:
            # the table and the set cost the same whatever the cover, so that cut is by hits alone; ranges beyond the set are paid for at every code
            for kind, code, range_ in (("table", costs.code, 0.0), ("native", costs.native, 0.0), ("native", costs.native, costs.range)):
                cut = least_cut(self.edges, len(pattern), counts, 1e-6, max(1e-6, range_ * total / verify))
                cover = Cover.of([r for e in cut for r in e.runs])
                tests = code + (costs.range * len(cover.ranges) if kind == "native" and len(cover.codes()) > SET_CODES else 0)
                self.ways.append(Way(kind, tests + verify * cover.hits(counts) / total, cut, cover))
        except ValueError:  # too many codes to list: no way by probing
            pass
        if len(pattern) <= AUTOMATON_PATTERN:
            self.ways.append(Way("automaton", costs.live + costs.step * self._live(counts)))
        self.ways.append(Way("decode", costs.decode))
        self.ways.sort(key=lambda w: w.cost)
        self.way = self.ways[0]
        probing = next((w for w in self.ways if w.cover is not None), None)
        self.whole = probing is None
        self.cut, self.cover = (probing.cut, probing.cover) if probing is not None else ([], Cover([], [(0, dictionary.num_tokens - 1)]))

    def _live(self, counts: list[int]) -> float:
        """The share of codes that the automaton has to follow: tokens that end with a start of the pattern, hold it, or lie within it."""
        pattern, live = self.pattern, 0
        starts = tuple(pattern[:k] for k in range(1, min(len(pattern), MAX_TOKEN) + 1))
        for i, t in enumerate(self.dictionary.tokens):
            if t.endswith(starts) or t in pattern or pattern in t:
                live += counts[i + 1] - counts[i]
        return live / counts[-1]

    def expected_hits(self, prefix: list[int]) -> int:
        if len(prefix) != self.dictionary.num_tokens + 1:
            raise FrequencyIndexMismatch(len(prefix) - 1, self.dictionary.num_tokens)
        return self.cover.hits(prefix) if self.cover is not None else prefix[-1]

    def explain(self) -> str:
        if self.cover is None:
            return "every row (empty pattern)"
        priced = ", ".join(f"{w.kind} {w.cost:.1f} ns a code" for w in self.ways)
        return f"by {self.way.kind}; probe {len(self.cover.points)} codes and {len(self.cover.ranges)} ranges, cut of {len(self.cut)} of {len(self.edges)} edges; priced: {priced}"


class Verifier:
    """Whether the pattern stands around hits of a cover: only the codes that reach into its neighbourhood are decoded."""

    def __init__(self, pattern: bytes, dictionary: Dictionary):
        from stringloom.operators.codec import Decoder

        self.pattern, self.decoder = pattern, Decoder(dictionary)

    def rows(self, codes: np.ndarray, at: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Whether each of the rows that begin at `at` holds the pattern; hits: places of codes of the cover, ascending."""
        out = np.zeros(len(at) - 1, bool)
        if not len(hits):
            return out
        n, reach = self.decoder.n, len(self.pattern) - 1
        row = np.searchsorted(at[1:], hits, "right")
        # a code is a byte at least
        lo, hi = np.maximum(at[row], hits - reach), np.minimum(at[row + 1], hits + 1 + reach)
        # neighbourhoods that touch, in a row, are decoded once
        new = np.concatenate([[True], (lo[1:] > hi[:-1]) | (row[1:] != row[:-1])])
        begin = np.flatnonzero(new)
        lo, row = lo[begin], row[begin]
        hi = np.maximum.reduceat(hi, begin)
        count = hi - lo
        places = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        near = codes[places]
        real = (near >= 0) & (near < n)  # a code outside the dictionary parts what it stands between
        offsets, data = self.decoder.gather(near if real.all() else np.where(real, near, 0))
        view = memoryview(data)
        if real.all():
            ends = offsets[np.concatenate([[0], np.cumsum(count)])].tolist()
            found = [self.pattern in bytes(view[a:b]) for a, b in zip(ends, ends[1:])]
        else:
            found = []
            for a, b in zip(np.cumsum(count) - count, np.cumsum(count)):
                pieces, since = [], a
                for bad in [*(a + np.flatnonzero(~real[a:b])), b]:
                    pieces.append(bytes(view[offsets[since] : offsets[bad]]))
                    since = bad + 1
                found.append(any(self.pattern in x for x in pieces))
        out[row[np.array(found, bool)]] = True
        return out
