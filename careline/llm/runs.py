"""Periodic runs of words, found in a grammar of each document.

A run is a stretch of consecutive words with smallest period q and a length of at least
``LEAST`` and ``POWER`` * q words that no neighbouring word extends.

1. Re-Pair, in rounds. The frequent pairs of neighbouring symbols of a document become rules X -> Y Z. In
   each round all pairs that occur more often than the pairs they overlap are replaced side by
   side, in all documents of a block; equal pairs that overlap each other are replaced from the left,
   every second one. Rounds end when no pair of a document occurs twice.
2. What is left of a document is the sequence of its start symbol, split in two again and again, near
   its middle, until single symbols are left: a balanced tree whose leaves are rules or words.
3. Each nonterminal, and each node of that tree, of at least ``LEAST`` words is looked at once, at its
   first place: the runs inside it that cross the boundary of its two parts. Such a run has a period q at
   which the four words behind the boundary come again later, or the four words in front of it came
   before; for each such q the run is extended both ways, by hashes of prefixes. Every run is
   then compared word by word; should a hash have misled, all is done again with others.
4. The runs of a nonterminal hold at all places of its derivations; intervals of equal period that
   share at least a period are merged. A run lies in a smallest node that holds it whole, and crosses its
   boundary, so none is missed; pieces of it, from smaller nodes, are merged into it.

Time is n log n in the words of a document. A task works through blocks of documents of about
``BLOCK`` words, nothing is shuffled; a longer document is a block of its own, so memory grows
with the longest text only.

Words are split in UTF-8 at blanks and the control characters 9 to 13. Defined cases: null and wordless texts
have no words and no runs, and the empty text as what is kept; repeated rows get a result each; columns of the names made
are replaced, others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from careline.llm.common import widened

#: Fewest words, and fewest periods, of a run.
LEAST, POWER = 24, 3
#: Words that must come again for a period to be tried; shorter than LEAST - LEAST / POWER.
GRAM = 4
#: Words of a block of documents.
BLOCK = 300_000
#: Moduli and bases of the two prefix hashes; the next two are for texts that mislead earlier ones.
HASHES = [((2147483647, 911382323), (2147483629, 972663749)), ((2147483587, 1103515245), (2147483579, 1664525)),
          ((2147483563, 40014), (2147483549, 69069))]


@dataclass
class Grammar:
    """Of a block: rules by number, the places of their derivations, and the start sequences."""

    whole: np.ndarray  # words of each rule
    left: np.ndarray  # words of its first part
    first: np.ndarray  # its first place
    rule_of: np.ndarray  # rule of each derivation, and its place
    place: np.ndarray
    symbols: np.ndarray  # places where symbols of the start sequences begin, in order


def numbered(words: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal words of one document only."""
    codes, seen = pd.factorize(np.array(words, object)) if words else (np.empty(0, np.int64), [])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return pd.factorize(doc * max(len(seen), 1) + codes)[0].astype(np.int64)


def re_pair(ids: np.ndarray, sizes: np.ndarray) -> Grammar:
    """The grammar of documents of ``sizes`` words whose numbers are ``ids``."""
    n = len(ids)
    symbol = ids.copy()
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.zeros(n + 1, bool)  # symbols that end a document
    stops = np.cumsum(sizes)
    last[stops[sizes > 0] - 1] = True
    last[n] = True
    here = np.ones(n, bool)
    words = np.ones(n + 1, np.int64)  # of the symbol that begins at a place
    live = np.flatnonzero(~last[:n])  # pairs (symbol, next one) that may occur twice
    next_symbol = int(ids.max()) + 1 if n else 0
    weight = np.zeros(n + 2)  # of the pair at a place in this round; 0 at places without one
    whole, left, first, rule_of, place, rules = [], [], [], [], [], 0
    rng = np.random.default_rng(3)
    while len(live):
        code, _ = pd.factorize(symbol[live] * (next_symbol + 1) + symbol[following[live]])
        count = np.bincount(code)
        often = count[code] > 1
        live, code = live[often], code[often]
        if not len(live):
            break
        weight[live] = (count + rng.random(len(count)))[code]
        # stretches of equal pairs that overlap each other
        joined = np.zeros(len(live), bool)
        joined[1:] = (following[live[:-1]] == live[1:]) & (code[1:] == code[:-1])
        head = np.flatnonzero(~joined)
        tail = np.append(head[1:], len(live)) - 1
        own = weight[live[head]]
        wins = (own > weight[before[live[head]]]) & (own > weight[following[live[tail]]])
        stretch = np.cumsum(~joined) - 1
        chosen = wins[stretch] & ((np.arange(len(live)) - head[stretch]) % 2 == 0)
        weight[live] = 0
        at, made = live[chosen], code[chosen]
        number, _ = pd.factorize(made)
        gone = following[at]
        new = int(number.max()) + 1
        one = np.empty(new, np.int64)
        one[number[::-1]] = at[::-1]
        whole.append(words[one] + words[following[one]])
        left.append(words[one])
        first.append(one)
        rule_of.append(number + rules)
        place.append(at)
        rules += new
        symbol[at] = number + next_symbol
        next_symbol += new
        words[at] += words[gone]
        last[at] = last[gone]
        here[gone] = False
        after = following[gone]
        following[at] = after
        before[after[after < n]] = at[after < n]
        changed = np.concatenate((at, before[at[before[at] >= 0]]))
        mark = np.zeros(n, bool)
        mark[live] = True
        mark[changed] = True
        mark &= here & ~last[:n]
        live = np.flatnonzero(mark)
    join = (lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64))
    return Grammar(join(whole), join(left), join(first), join(rule_of), join(place), np.flatnonzero(here))


def tree_nodes(symbols: np.ndarray, stops: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """start, boundary and end (in words) of the nodes over the start sequences that have two symbols and
    ``least`` words or more. ``stops``: ends of documents."""
    edge = np.append(symbols, stops[-1] if len(stops) else 0)
    cut = np.unique(np.searchsorted(edge, np.concatenate(([0], stops))))
    low, high = cut[:-1], cut[1:]  # symbols of each node
    found = []
    while len(low):
        keep = (high - low > 1) & (edge[high] - edge[low] >= least)
        low, high = low[keep], high[keep]
        middle = np.searchsorted(edge, (edge[low] + edge[high]) / 2)
        nearer = edge[middle] - (edge[low] + edge[high]) / 2 > (edge[low] + edge[high]) / 2 - edge[middle - 1]
        middle = np.clip(middle - nearer, low + 1, high - 1)
        found.append((edge[low], edge[middle], edge[high]))
        low, high = np.concatenate((low, middle)), np.concatenate((middle, high))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


class Prefixes:
    """Hashes of prefixes, to compare stretches of words of a block."""

    def __init__(self, ids: np.ndarray, attempt: int = 0):
        self.hashes, self.sums, self.powers = HASHES[attempt], [], []
        rng = np.random.default_rng(11 + attempt)
        for prime, base in self.hashes:
            p = np.uint64(prime)
            powers = np.ones(len(ids) + 1, np.uint64)
            have, factor = 1, base
            while have < len(powers):  # twice as many known powers each time
                more = min(have, len(powers) - have)
                powers[have:have + more] = powers[:more] * np.uint64(factor) % p
                have, factor = have + more, factor * factor % prime
            value = rng.integers(1, prime, int(ids.max()) + 1 if len(ids) else 1, np.uint64)
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(value[ids] * powers[:-1] % p, out=sums[1:])
            self.sums.append(sums % p)
            self.powers.append(powers)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words at ``a`` and, further on, at ``b`` are equal, by their hashes."""
        equal = np.ones(len(a), bool)
        for (prime, _), sums, powers in zip(self.hashes, self.sums, self.powers):
            p = np.uint64(prime)
            x = (sums[a + n] + p - sums[a]) % p * powers[b - a] % p
            equal &= x == (sums[b + n] + p - sums[b]) % p
        return equal

    def extended(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """Words from ``a`` and from ``b`` on (``step`` 1), or in front of them (-1), that are equal; ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            n = (low + high + 1) // 2
            back = n if step < 0 else 0
            fits = self.same(a - back, b - back, n)
            low, high = np.where(fits, n, low), np.where(fits, high, n - 1)
        return low


def crossing(prefixes: Prefixes, start: np.ndarray, boundary: np.ndarray, end: np.ndarray,
             grams: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """The runs of each node that cross its boundary: (node, start, end, period)."""
    reach = (end - start) // power
    ahead = np.minimum(reach, np.maximum(end - boundary - 1, 0))
    behind = np.minimum(reach, np.maximum(boundary - start - GRAM, 0))
    parts = []
    for size, sign in ((ahead, 1), (behind, -1)):
        node = np.repeat(np.arange(len(start)), size)
        period = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + 1
        anchor = boundary[node] if sign > 0 else boundary[node] - GRAM
        ok = grams[anchor] == grams[np.maximum(anchor + sign * period, 0)]
        node, period = node[ok], period[ok]
        low = boundary[node] - (period if sign < 0 else 0)  # the place before which both directions meet
        parts.append((node, low, period))
    node, at, period = (np.concatenate(x) for x in zip(*parts))
    more = prefixes.extended(at, at + period, end[node] - at - period, 1)
    less = prefixes.extended(at, at + period, at - start[node], -1)
    first, stop = at - less, at + more + period
    ok = (stop - first >= least) & (stop - first >= power * period)
    node, first, stop, period = node[ok], first[ok], stop[ok], period[ok]
    return _smallest(node, first, stop, period)


def _smallest(node: np.ndarray, first: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal stretches of a node the one with the smallest period."""
    order = np.lexsort((period, stop, first, node))
    node, first, stop, period = node[order], first[order], stop[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (first[1:] != first[:-1]) | (stop[1:] != stop[:-1])
    return node[new], first[new], stop[new], period[new]


def _checked(ids: np.ndarray, found: tuple[np.ndarray, ...]) -> bool:
    """Whether all runs have their periods, word by word."""
    return all(np.array_equal(ids[first:stop - period], ids[first + period:stop])
               for first, stop, period in zip(*(x.tolist() for x in found[1:])))


def all_crossing(ids: np.ndarray, start: np.ndarray, boundary: np.ndarray, end: np.ndarray,
                 least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """``crossing``, checked, for any number of nodes."""
    value = np.random.default_rng(13).integers(1, 2**63, int(ids.max()) + 1, np.uint64)[ids]
    grams = np.zeros(len(ids), np.uint64)
    for k in range(GRAM):
        grams[:len(ids) - k] += value[k:] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for attempt in range(len(HASHES)):
        prefixes, held = Prefixes(ids, attempt), []
        for part in _bounded(end - start, 4_000_000):
            found = crossing(prefixes, start[part], boundary[part], end[part], grams, least, power)
            if not _checked(ids, found):
                break
            held.append((found[0] + part.start, *found[1:]))
        else:
            return tuple(np.concatenate(x) for x in zip(*held))
    raise RuntimeError("unequal stretches share every hash")


def merged(first: np.ndarray, stop: np.ndarray, period: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maximal intervals of each document and period: (doc, start, end, period), by start, then period."""
    if not len(first):
        return doc, first, stop, period
    order = np.lexsort((-stop, first, period, doc))
    first, stop, period, doc = first[order], stop[order], period[order], doc[order]
    group = np.ones(len(first), bool)
    group[1:] = (doc[1:] != doc[:-1]) | (period[1:] != period[:-1])
    base = np.cumsum(group) * (int(stop.max()) + 1)  # later groups lie behind earlier ones
    furthest = np.maximum.accumulate(stop + base) - base
    new = group.copy()
    new[1:] |= first[1:] + period[1:] > furthest[:-1]
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(first)) - 1
    out = (doc[at], first[at], furthest[ends], period[at])
    order = np.lexsort((out[3], out[1], out[0]))
    return tuple(x[order] for x in out)


def runs_of(words: list[bytes], sizes: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """Runs of documents of ``sizes`` words each: (document, start, end, period), places within the document."""
    ids = numbered(words, sizes)
    stops = np.cumsum(sizes)
    grammar = re_pair(ids, sizes)
    big = np.flatnonzero(grammar.whole >= least)
    nodes = tree_nodes(grammar.symbols, stops, least)
    start = np.concatenate((grammar.first[big], nodes[0]))
    boundary = np.concatenate((grammar.first[big] + grammar.left[big], nodes[1]))
    end = np.concatenate((grammar.first[big] + grammar.whole[big], nodes[2]))
    if not len(start):
        return (np.empty(0, np.int64),) * 4
    node, first, stop, period = all_crossing(ids, start, boundary, end, least, power)
    # a run of a rule holds wherever the rule is derived
    inside = node < len(big)
    rule, offset = big[node[inside]], (first - start[node])[inside]
    order = np.argsort(grammar.rule_of, kind="stable")
    low = np.searchsorted(grammar.rule_of[order], np.arange(len(grammar.whole) + 1))
    times = low[rule + 1] - low[rule]
    which = np.repeat(np.arange(len(rule)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    begin = grammar.place[order][low[rule][which] + nth] + offset[which]
    length = stop - first
    first = np.concatenate((first[~inside], begin))
    length = np.concatenate((length[~inside], length[inside][which]))
    period = np.concatenate((period[~inside], period[inside][which]))
    doc, first, stop, period = merged(first, first + length, period, np.searchsorted(stops, first, "right"))
    shift = (stops - sizes)[doc]
    return doc, first - shift, stop - shift, period


def _bounded(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes add up to about ``most``."""
    part = np.cumsum(sizes) // most
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield slice(a, b)


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        edge[start + period] += 1
        edge[end] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


MADE = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string")


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The values of ``MADE`` for a document with its runs (start, end, period), by start, then period."""
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs).encode()
    digest = hashlib.sha256(listed).hexdigest()
    kept = hashlib.sha256(b" ".join(without_repeats(words, runs) if runs else words)).hexdigest()
    if not runs:
        return 0, None, None, None, None, digest, kept
    a, b, q = runs[0]
    for x, y, p in runs[1:]:
        more = (y - x) * q - (b - a) * p
        if more > 0 or (more == 0 and (x, p) < (a, q)):
            a, b, q = x, y, p
    return len(runs), a, b - a, q, 1000 * (b - a) // q, digest, kept


def with_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
              texts: bool = False, block: int = BLOCK) -> DataFrame:
    """The columns ``keep`` (by default all) with ``MADE``: the number of runs, the one with the greatest
    length by period, and digests of all runs and of the words without repeats. With ``texts`` also
    ``runs`` (start, length, period of each) and ``collapsed``, the text without repeats."""
    more = MADE + ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" * texts
    new = [f.name for f in StructType.fromDDL(more).fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary").alias("_raw"))
    schema = widened(docs.select([F.col(f"`{c}`") for c in kept]), more)
    types = [to_arrow_type(f.dataType) for f in schema.fields[len(kept):]]

    def results(split: list[list[bytes]]) -> list[tuple]:
        sizes = np.array([len(w) for w in split], np.int64)
        found = runs_of([w for words in split for w in words], sizes)
        of = np.searchsorted(found[0], np.arange(len(split) + 1)).tolist()
        spans = list(zip(*(x.tolist() for x in found[1:])))
        out = []
        for i, words in enumerate(split):
            runs = spans[of[i]:of[i + 1]]
            row = summary(words, runs)
            if texts:
                row += ([{"start": a, "length": b - a, "period": q} for a, b, q in runs],
                        b" ".join(without_repeats(words, runs)).decode())
            out.append(row)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, done = batch.column(len(kept)), 0
            while done < len(raw):
                split, held, at = [], 0, done
                while at < len(raw) and (not held or held < block):  # one text at a time is taken out of Arrow
                    split.append((raw[at].as_py() or b"").split())
                    held += len(split[-1]) + 1
                    at += 1
                columns = list(zip(*results(split)))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(done, at - done) for c in batch.columns[:len(kept)]),
                     *(pa.array(list(v), t) for v, t in zip(columns, types))], names=schema.names)
                done = at

    return source.mapInArrow(run, schema)
