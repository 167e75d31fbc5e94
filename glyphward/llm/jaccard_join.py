"""Operator 4: documents whose n-gram sets have Jaccard similarity of at least THETA, exactly.

Texts of one word sequence are one node, so copies are never compared with each other.

Sets with J(r, s) >= THETA and sizes |s| <= |r| differ in at most H = floor((1 - THETA) / (1 + THETA) * (|r| + |s|))
n-grams.  Sizes fall in bands; each band divides the universe of n-grams into m segments by hash, of which the first d
also count as equal when one n-gram is missing on either side (one-deletion neighbourhoods).  If the segments that a set
indexes weigh more than H, every partner agrees with it on one of them, and on as much weight as is left over.  A set is
indexed under its own band, and under the band below when partners can lie there.

Which segments are indexed is decided by cost.  A segment's content is indexed only if it is rare enough (the n-grams'
information, from word frequencies of the whole corpus, must reach log2 of the number of documents, less a constant), and
n-grams that tell too little take no part.  m, d and what takes part are those of the fewest index entries.  The decision is
a function of band and content, hence the same for both partners.

The finest division of the universe makes every n-gram a segment.  Then only the n-grams that a set itself has and its
partner lacks count, at most (1 - THETA) of them, so it lists that many of its rarest ones and a share of SPARE more, on
which partners must agree.  Sets for which the segments leave too little room are indexed there; a band for which that is
the cheaper way for all its sets has no segments (m = 0).  At THETA = 0.6 that is so wherever single n-grams are rare, since
H is two thirds of a set; segments pay at higher thresholds, or in corpora so large that single n-grams are common.

Where every band (but of tiny sets) is of the finest division, the number of sets that have an n-gram is counted first, and sets are listed
under their rarest n-grams by that count (``_listed_pairs``), which takes far fewer and shorter lists than estimates do: an n-gram
that one set alone has is never listed.  Sets whose n-grams are too common for that, the more the larger the corpus, are listed
under two n-grams at a time.  What follows on entries holds for the other way.

An entry that more than HOT sets share is passed over, and counted as a loss of each.  Sets that lose more than their room
are joined on such entries among themselves, up to CROWD sets an entry; those that lose too many of even larger ones are
tied to one set of each.  None of this drops a pair: frequencies steer cost only.

Pairs that agree on less weight than they must are dropped.  The others are edges; each connected component of them is
verified exactly, from the texts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, U64, bucket_cuts, drop_staged, hash_tokens, mix, ngram_hashes, pack_sorted, planes, powers, slices, stage_table, string_buffers, text_bytes, tidy, unpack_sorted, unplanes
from .components import components

#: Below the near copies that the tables hold: a replaced word costs two bigrams, so with a share f replaced the similarity
#: is about (1 - 2f) / (1 + 2f), 0.67 at f = 0.1.
THETA = 0.6
N = 2
#: An index entry of more sets than this is passed over (see above).
HOT = 16
#: Words of the texts that one block of a component holds.
BLOCK = 1_000_000
#: Of sets that lose too many such entries, entries of up to so many are joined (see above).
CROWD = 128
#: Bytes of text that one call verifies, on average.
BIN_BYTES = 4 << 20
#: Bytes of text whose index entries one bucket holds.
BUCKET_BYTES = 8 << 20
#: The space of sets that are indexed by single n-grams.
FINEST = -1
_STEP = 1 << 20
_RARE = 16  # bits at most that a word counts
_COMMON = 1.0 / (1 << _RARE)
_SPARE = 0.15  # share of n-grams that sets list more than one of which must agree, in the finest space
_STRANGERS = 3  # log2 of the strangers that an entry may be expected to meet
_TINY = 3  # n-grams of a set that is listed cheaply either way
_AGREE = 0.1  # share of the n-grams common to partners that must be among the listed ones, one more at least
_KEY = U64(0xFFFFFFFFFF000000)  # n-grams are counted and listed by 40 bits of their hash; more that are equal cost time only


def _ordered(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Order by row, then by the keys: 64-bit hashes, the first of two a number below 2**16.  One sort of packed keys, where
    these tell all apart; else a slower one."""
    if len(rows) and int(rows.max()) < 1 << 20:
        packed = rows.astype(U64) << U64(44)
        used = 20
        if len(keys) > 1:
            packed |= keys[0].astype(U64) << U64(28)
            used = 36
        packed |= keys[-1] >> U64(used)
        order = np.argsort(packed)
        twin = np.flatnonzero(packed[order[1:]] == packed[order[:-1]])
        if (keys[-1][order[twin]] == keys[-1][order[twin + 1]]).all():
            return order
    return np.lexsort((*keys[::-1], rows))


def ngram_sets(texts, n: int) -> tuple[np.ndarray, ...]:
    """Distinct n-grams of texts, ordered by text: (hashes, offsets, first word's hash, last word's hash), and the texts' keys.

    A text of 1..n-1 words has one n-gram, all of it."""
    data, offsets = string_buffers(texts)
    h, _, _, tok = hash_tokens(data, offsets, "word")
    g, rows = ngram_hashes(h, tok, n, short=True)
    counts = np.diff(tok)
    full = np.maximum(counts - n + 1, 0)
    at = np.repeat(tok[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    some = np.flatnonzero((counts > 0) & (counts < n))
    first = np.concatenate([h[at], h[tok[some]]]) if len(h) else h
    last = np.concatenate([h[at + n - 1], h[tok[some + 1] - 1]]) if len(h) else h
    order = _ordered(rows, g)
    g, rows = g[order], rows[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    order = order[keep]
    return g[keep], np.searchsorted(rows[keep], np.arange(len(offsets))), first[order], last[order], text_keys(h, tok)


# ---------------------------------------------------------------- cost model


def word_bits(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, bits) of all words with a share of at least 2**-16 of the corpus, at most 65,536 of them, and the number of
    texts.  Each part of a few MB reports words with half that share in it; only cost depends on the result."""

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, 4 * _STEP):
                h, _, _, _ = hash_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "word")
                u, n = np.unique(h, return_counts=True)
                keep = n >= len(h) * _COMMON / 2
                u, n = np.append(u[keep], U64(0)), np.append(n[keep], len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(n, pa.int64()), pa.array([0] * (len(u) - 1) + [j - i], pa.int64())], names=["h", "n", "docs"]
                )

    found = docs.select("text").mapInArrow(tidy(run), "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = stage_table(found, "words")
    total = found.filter("h = 0").first()
    if total is None or not total["n"]:
        return np.zeros(0, U64), np.zeros(0), int(total["docs"]) if total else 0
    table = found.filter((F.col("h") != 0) & (F.col("n") >= int(math.ceil(total["n"] * _COMMON)))).select("h", "n").toArrow()
    h = table.column("h").to_numpy().view(U64)
    b = -np.log2(table.column("n").to_numpy() / total["n"])
    drop_staged(found)
    order = np.argsort(h)
    return h[order], np.round(b[order] * 1024) / 1024, int(total["docs"])


class Plan:
    """Bands of sizes, and for each: the bits that an n-gram needs to take part, the segments m, and the deep ones d.
    Without segments (m = 0) a band's sets are indexed in the finest space only."""

    def __init__(self, words: np.ndarray, bits: np.ndarray, n_docs: int, theta: float):
        self.theta, self.words, self.bits = theta, words, bits
        self.need_bits = max(1.0, math.log2(max(2, n_docs)) - _STRANGERS)
        p = np.exp2(-bits)
        rest = max(0.0, 1 - p.sum())
        share, value = np.append(p, rest), np.append(bits, float(_RARE))
        rng = np.random.default_rng(7)
        drawn = rng.choice(len(share), (2, 100_000), p=share / share.sum())
        self.sample = value[drawn[0]] + value[drawn[1]]
        self.his = [1]
        self._made: dict[int, tuple[float, int, int]] = {}

    def reach(self, size: int) -> None:
        """Bands go on without an end; so far that they cover sets of this size."""
        while self.his[-1] < size:
            self.his.append(max(self.his[-1] + 1, int(self.his[-1] / self.theta**2)))

    def differences(self, size: int) -> int:
        """H for a set's partners that are no smaller, or in its own band."""
        return int((1 - self.theta) / self.theta * size + 1e-9)

    def scheme(self, band: int) -> tuple[float, int, int]:
        if band not in self._made:
            while len(self.his) <= band:
                self.reach(self.his[-1] + 1)
            self._made[band] = self._choose(band)
        return self._made[band]

    def price(self, band: int) -> float:
        """Bits that an n-gram is worth less in a band, since a set there has so many that could be it."""
        lo = self.his[band - 1] + 1 if band else 1
        return 0.5 * math.log2(lo * self.his[band])

    def _choose(self, band: int) -> tuple[float, int, int]:
        hi = self.his[band]
        lo = self.his[band - 1] + 1 if band else 1
        worth, need = self.sample - self.price(band), self.need_bits
        fine = {size: int((1 - self.theta + _SPARE) * size) + 2 for size in (lo, hi)}
        best = float(sum(fine[size] for size in {lo, hi})), 0.0, 0, 0
        for cut in (-1e9, need / 4, need / 3, need / 2, need):
            pool = worth[worth >= cut]
            part = len(pool) / len(worth)
            if not len(pool):
                continue
            for m in sorted({max(1, round(part * hi / x)) for x in (0.5, 0.75, 1, 1.5, 2, 2.5, 3, 4, 5, 6, 8)}):
                at = {}
                for size in {lo, hi}:
                    rng = np.random.default_rng(11)
                    n = rng.poisson(part * size / m, 2000) if m > 1 else rng.binomial(size, part, 50)
                    b = pool[rng.integers(0, len(pool), n.sum())]
                    seg = np.repeat(np.arange(len(n)), n)
                    total = np.bincount(seg, b, len(n))
                    most = np.zeros(len(n))
                    np.maximum.at(most, seg, b)
                    one = (n > 0) & (total >= need)
                    two = (n > 1) & (total - most >= need)
                    at[size] = one, two, n
                for d in sorted({round(m * x / 4) for x in range(5)}):
                    cost = 0.0
                    for size, (one, two, n) in at.items():
                        mean = m * one.mean() + d * two.mean()
                        sd = math.sqrt((m - d) * one.var() + d * (one.astype(int) + two).var() + 1e-9)
                        short = 0.5 * math.erfc((mean - self.differences(size) - _SPARE * size - 0.5) / sd / math.sqrt(2))
                        cost += m * one.mean() + d * (two * n).mean() + short * fine[size]
                    if cost < best[0]:
                        best = cost, cut, m, d
        return best[1:]


def _entries(plan: Plan, g, offsets, first, last):
    """Index entries of sets: (signature, owner, kind), and the owners: (set, space, weight, room).

    Kinds: 0, a segment's content without one n-gram; 1, content of weight 1; 2 + t, content of t n-grams, of weight 2.
    A space is a band, or ``FINEST``: every n-gram is a segment by itself.
    """
    sizes = np.diff(offsets)
    if not len(g):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, np.zeros(0, np.uint8), (none, none, none, none)
    plan.reach(int(sizes.max()))
    his = np.array(plan.his)
    band = np.searchsorted(his, sizes)
    live = np.flatnonzero(sizes > 0)
    below = live[(band[live] > 0) & (np.ceil(plan.theta * sizes[live] - 1e-9) <= his[np.maximum(band[live] - 1, 0)])]
    own_set = np.concatenate([live, below])
    own_band = np.concatenate([band[live], band[below] - 1])
    k = sizes[own_set]
    share = (1 - plan.theta) / (1 + plan.theta)
    need = np.where(own_band == band[own_set], (1 - plan.theta) / plan.theta * k, share * (k + np.minimum(his[own_band], k)))
    need = np.floor(need + 1e-9).astype(np.int64) + 1
    schemes = np.array([plan.scheme(b) + (plan.price(b),) for b in range(int(own_band.max()) + 1)])
    cut, m, d, price = schemes[own_band, 0], schemes[own_band, 1].astype(np.int64), schemes[own_band, 2].astype(np.int64), schemes[own_band, 3]

    def bits_of(w):
        if not len(plan.words):
            return np.full(len(w), float(_RARE))
        i = np.minimum(np.searchsorted(plan.words, w), len(plan.words) - 1)
        return np.where(plan.words[i] == w, plan.bits[i], float(_RARE))

    info = bits_of(first) + bits_of(last)
    owner = np.repeat(np.arange(len(own_set)), k)
    at = np.repeat(offsets[own_set] - (np.cumsum(k) - k), k) + np.arange(len(owner))
    b = info[at] - price[owner]
    takes = np.flatnonzero((b >= cut[owner]) & (m[owner] > 0))
    owner, at, b = owner[takes], at[takes], b[takes]
    seg = ((g[at] >> U64(32)) * m[owner].astype(U64) >> U64(32)).astype(np.int64)
    key = (owner << 32) + seg
    order = np.argsort(key, kind="stable")
    key, at, b, owner = key[order], at[order], b[order], owner[order]
    x = mix(g)[at]
    out = []
    weight = np.zeros(len(own_set), np.int64)
    if len(key):
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        t = np.diff(np.append(heads, len(key)))
        # sums of floats may depend on order; contents are compared in whole 1/1024 bits
        total = np.round(np.add.reduceat(b, heads) * 1024) / 1024
        most = np.maximum.reduceat(b, heads)
        sums = np.add.reduceat(x, heads)
        ho, hs = owner[heads], key[heads] & 0xFFFFFFFF
        salt = mix((own_band[ho] * (1 << 32) + hs).astype(U64) + U64(1))
        near = plan.need_bits
        one = total >= near
        two = one & (hs < d[ho]) & (t > 1) & (np.round((total - most) * 1024) / 1024 >= near)
        weight = np.bincount(ho, one.astype(np.int64) + two, len(own_set)).astype(np.int64)
        out.append((mix(sums[one] + salt[one]), ho[one], np.where(two, 2 + np.minimum(t, 200), 1)[one].astype(np.uint8)))
        # what is left without one n-gram is listed wherever it is rare enough by itself, as content would be
        group = np.repeat(np.arange(len(heads)), t)
        rest = np.flatnonzero((hs < d[ho])[group] & (t > 1)[group] & (np.round((total[group] - b) * 1024) / 1024 >= near))
        out.append((mix(sums[group[rest]] - x[rest] + salt[group[rest]]), owner[rest], np.zeros(len(rest), np.uint8)))
    short = weight < need + np.floor(_SPARE * k).astype(np.int64)
    room = np.where(short, -1, np.minimum(weight - need, 1 << 24))
    owners = [own_set, own_band, weight, room]
    few = np.unique(own_set[short])
    if len(few):  # indexed again by their rarest n-grams, among such sets
        n = sizes[few]
        which = np.repeat(np.arange(len(few)), n)
        at = np.repeat(offsets[few] - (np.cumsum(n) - n), n) + np.arange(len(which))
        order = _ordered(which, ((2 * _RARE - info[at]) * 1024).astype(np.int64), g[at])
        which, at = which[order], at[order]
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        agree = 1 + np.floor(_SPARE * n + 1e-9).astype(np.int64)
        head = place < (np.floor((1 - plan.theta) * n + 1e-9).astype(np.int64) + agree)[which]
        out.append((mix(g[at[head]] + U64(0x51ED270B)), len(own_set) + which[head], np.ones(int(head.sum()), np.uint8)))
        least = np.ceil(plan.theta * n - 1e-9)  # of a partner, which lists so many more
        more = (few, np.full(len(few), FINEST), agree, np.floor(_SPARE * least + 1e-9).astype(np.int64))
        owners = [np.concatenate(z) for z in zip(owners, more)]
    sig, own, kind = (np.concatenate([o[i] for o in out]) for i in range(3))
    return sig, own, kind, tuple(owners)


def text_keys(h: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's word sequence: texts of one key are one node."""
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    shift = powers(len(h) + 1, inverse=True)[tok[:-1]]
    return mix((sums[tok[1:]] - sums[tok[:-1]]) * shift + np.diff(tok).astype(U64)).view(np.int64)


_BLOB = ["sigs", "owner", "kind", "nodes", "spaces", "sizes", "weights", "rooms"]


def _index(plan: Plan, n: int, n_buckets: int):
    def run(batches):
        seen: set[int] = set()  # of equal sets, a task sends one
        for batch in batches:
            _, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, _STEP):
                g, off, first, last, names = ngram_sets(batch.column("text").slice(i, j - i), n)
                fresh = np.zeros(j - i, bool)
                fresh[np.unique(names, return_index=True)[1]] = True
                fresh &= (np.diff(off) > 0) & np.array([x not in seen for x in names.tolist()], bool)
                seen.update(names[fresh].tolist())
                sizes = np.where(fresh, np.diff(off), 0)
                keep = np.repeat(fresh, np.diff(off))
                off = np.concatenate([[0], np.cumsum(sizes)])
                sig, own, kind, (o_set, *o_rest) = _entries(plan, g[keep], off, first[keep], last[keep])
                order = np.argsort(sig, kind="stable")
                sig, own, kind = sig[order], own[order], kind[order]
                cuts = bucket_cuts(sig, n_buckets)
                rows = {k: [] for k in ["bucket", *_BLOB]}
                for b in np.flatnonzero(np.diff(cuts)):
                    p, q = cuts[b], cuts[b + 1]
                    used, back = np.unique(own[p:q], return_inverse=True)
                    of = (names[o_set[used]], *(v[used].astype(np.int32) for v in (o_rest[0], sizes[o_set], o_rest[1], o_rest[2])))
                    blob = (pack_sorted(sig[p:q]), planes(back.astype(np.uint32)), kind[p:q].tobytes(), *map(planes, of))
                    for name, v in zip(rows, (int(b), *blob)):
                        rows[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32())] + [pa.array(rows[k], pa.binary()) for k in _BLOB], names=list(rows))

    return run


def _meet(hot: int, theta: float):
    """Of a bucket: pairs of sets with the weight on which they agree there, and the entries of more than ``hot`` sets."""
    share = (1 - theta) / (1 + theta)

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in _BLOB}
        sig = np.concatenate([unpack_sorted(b) for b in cols["sigs"]])
        kind = np.concatenate([np.frombuffer(b, np.uint8) for b in cols["kind"]])
        base, own, of = 0, [], {k: [] for k in _BLOB[3:]}
        for i, o in enumerate(cols["owner"]):
            own.append(unplanes(o, np.uint32).astype(np.int64) + base)
            for k, v in of.items():
                v.append(unplanes(cols[k][i], np.int64 if k == "nodes" else np.int32))
            base += len(of["nodes"][-1])
        own = np.concatenate(own)
        node, space, size, weight, room = (np.concatenate(v) for v in of.values())
        order = np.argsort(sig, kind="stable")
        sig, kind, own = sig[order], kind[order], own[order]
        # entries of one set alone need no look
        twin = sig[1:] == sig[:-1]
        keep = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
        sig, kind, own = sig[keep], kind[keep], own[keep]
        order = np.lexsort((node[own], sig))
        sig, kind, own = sig[order], kind[order], own[order]
        who = node[own]
        once = np.ones(len(sig), bool)  # an equal set that another task sent
        once[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
        sig, kind, own, who = sig[once], kind[once], own[once], who[once]
        new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] if len(sig) else np.zeros(0, np.int64)
        is_hot = many > hot
        value = np.where(kind < 2, 1, 4 - kind.astype(np.int64))
        held = [np.zeros(0, np.int64)] * 4
        parts: list[tuple] = []

        def settle():
            a, b, s, v = (np.concatenate([x[c] for x in parts]) for c in range(4))
            order = np.lexsort((s, node[b], node[a]))
            a, b, s, v = a[order], b[order], s[order], v[order]
            first = np.ones(len(a), bool)
            first[1:] = (node[a][1:] != node[a][:-1]) | (node[b][1:] != node[b][:-1]) | (s[1:] != s[:-1])
            first = np.flatnonzero(first)
            return [a[first], b[first], s[first], np.add.reduceat(v, first) if len(first) else v]

        cold = np.flatnonzero(~is_hot & (many > 1))
        for start in range(0, len(cold), 1 << 18):
            own_part = cold[start : start + (1 << 18)]
            for lag in range(1, hot):
                i = own_part[own_part + lag < len(sig)]
                i = i[group[i + lag] == group[i]]
                own_part = i
                if not len(i):
                    break
                a, b = own[i], own[i + lag]
                fits = np.minimum(size[a], size[b]) >= theta * np.maximum(size[a], size[b]) - 1e-9
                i, a, b = i[fits], a[fits], b[fits]
                same = (kind[i] > 0) & (kind[i + lag] > 0)
                parts.append((a, b, space[a].astype(np.int64), np.where(same, value[i], 1)))
            if sum(len(x[0]) for x in parts) > 1 << 20:
                parts = [tuple(settle())]
        a, b, s, agreed = settle() if parts else held
        most = np.floor(share * (size[a].astype(np.int64) + size[b]) + 1e-9).astype(np.int64)
        fine = s == FINEST
        floor_a, floor_b = (np.where(fine, np.minimum(weight[a], weight[b]), weight[z] - most) for z in (a, b))
        k, h = len(a), int(is_hot.sum())
        o = own[is_hot]
        both = lambda x, y, t: pa.array(np.concatenate([x, y]).astype(t))
        return pa.table(
            {
                "hot": pa.array(np.concatenate([np.zeros(k, bool), np.ones(h, bool)])),
                "a": both(node[a], sig[is_hot].view(np.int64), np.int64),
                "b": both(node[b], node[o], np.int64),
                "space": both(s, space[o], np.int32),
                "agreed": both(agreed, size[o], np.int32),
                "floor_a": both(floor_a, weight[o], np.int32),
                "floor_b": both(floor_b, room[o], np.int32),
            }
        )

    return run


def _crowded(met: DataFrame, theta: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of the entries of more than HOT sets: (pairs that meet on them, losses of each set, star links).

    Only sets whose loss exceeds their room need them.  Among these, lists of up to ``most`` are joined, so only longer ones
    are lost; sets whose room even that exceeds are tied to the least set of each list, as long as the list is.
    """
    shared = met.filter("hot").select(F.col("a").alias("sig"), F.col("b").alias("node"), "space", F.col("agreed").alias("size"), F.col("floor_a").alias("weight"), F.col("floor_b").alias("room"))
    lost = shared.groupBy("node", "space").agg(F.count(F.lit(1)).alias("loss"), F.max("room").alias("room"))
    dense = shared.join(lost.filter("loss > room").select("node", "space", "loss"), ["node", "space"])
    # sets without any room (room = -1) rely on others of the list, or on the finest space
    lists = dense.groupBy("sig", "space").agg(F.count(F.lit(1)).alias("members"), F.max("room").alias("best")).filter("best >= 0 and members > 1")
    dense = stage_table(dense.join(lists.select("sig", "space", "members"), ["sig", "space"]), "crowded", free=True)
    mid = dense.filter(F.col("members") <= most)
    left, right = (mid.select("sig", "space", *[F.col(c).alias(c + x) for c in ("node", "size", "weight")]) for x in "ab")
    met_again = left.join(right, ["sig", "space"]).filter("nodea < nodeb").filter(F.least("sizea", "sizeb") >= theta * F.greatest("sizea", "sizeb") - 1e-9)
    apart = F.floor((F.col("sizea") + F.col("sizeb")) * ((1 - theta) / (1 + theta)) + 1e-9).cast("int")
    fine = F.col("space") == FINEST
    floors = [F.when(fine, F.least("weighta", "weightb")).otherwise(F.col(f"weight{x}") - apart).alias(f"floor_{x}") for x in "ab"]
    pairs = met_again.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), "space", F.lit(1).alias("agreed"), *floors)
    top = dense.filter(F.col("members") > most)
    over = top.groupBy("node", "space").agg(F.count(F.lit(1)).alias("over"), F.max("room").alias("room"))
    there = dense.select("node", "space").distinct().withColumn("dense", F.lit(True))
    loss = lost.join(there, ["node", "space"], "left").join(over.select("node", "space", "over"), ["node", "space"], "left")
    loss = loss.select("node", "space", "loss", F.coalesce("dense", F.lit(False)).alias("dense"), F.coalesce("over", F.lit(0)).alias("over"))
    tied = top.join(over.filter("over > room").select("node", "space"), ["node", "space"], "left_semi")
    hubs = tied.groupBy("sig", "space").agg(F.min("node").alias("hub"), F.max("room").alias("best")).filter("best >= 0")
    stars = tied.join(hubs, ["sig", "space"]).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return pairs, loss, stars


# ---------------------------------------------------------------- lists by counted frequency


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """node, text: of texts with words, of one node one from each task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            _, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, _STEP):
                part = batch.column("text").slice(i, j - i)
                data, off = string_buffers(part)
                h, _, _, tok = hash_tokens(data, off, "word")
                names = text_keys(h, tok)
                fresh = np.zeros(j - i, bool)
                fresh[np.unique(names, return_index=True)[1]] = True
                fresh &= (np.diff(tok) > 0) & np.array([x not in seen for x in names.tolist()], bool)
                seen.update(names[fresh].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(names[fresh]), part.filter(pa.array(fresh))], names=["node", "text"])

    return docs.select("text").mapInArrow(tidy(run), "node long, text string")


def _chunk_sets(table: pa.Table, n: int) -> tuple[np.ndarray, ...]:
    """Of a chunk: (nodes in order, sizes, n-grams by set, their distinct keys in order, each n-gram's place there)."""
    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    texts = table.column("text").take(pa.array(first))
    _, offsets = string_buffers(texts)
    sizes, grams = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for i, j in slices(offsets, _STEP):
        g, off = ngram_sets(texts.slice(i, j - i), n)[:2]
        sizes.append(np.diff(off))
        grams.append(g)
    g = np.concatenate(grams)
    keys, back = np.unique(g & _KEY, return_inverse=True)
    return nodes, np.concatenate(sizes), g, keys, back


def _level(df):
    """Numbers of sets in a byte, in order: exact up to 160."""
    df = np.asarray(df, np.float64)
    return np.where(df <= 160, df, 160 + np.minimum(95, np.ceil(6 * np.log2(np.maximum(df, 160) / 160)))).astype(np.uint8)


def _chunk_counts(n: int, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, _, keys, back = _chunk_sets(table, n)
        times = np.bincount(back, minlength=len(keys)).astype(np.uint32)
        cuts = bucket_cuts(keys, n_buckets)
        some = np.flatnonzero(np.diff(cuts))
        chunk = table.column("chunk")[0].as_py()
        spans = [(cuts[b], cuts[b + 1]) for b in some]
        return pa.table(
            {
                "chunk": pa.array([chunk] * len(some), pa.int32()),
                "bucket": pa.array(some, pa.int32()),
                "keys": pa.array([pack_sorted(keys[p:q]) for p, q in spans], pa.binary()),
                "times": pa.array([planes(times[p:q]) for p, q in spans], pa.binary()),
            }
        )

    return run


def _bucket_counts(table: pa.Table) -> pa.Table:
    """Each blob's keys, as the level of how many sets of all chunks have them."""
    blobs = [unpack_sorted(b) for b in table.column("keys").to_pylist()]
    times = np.concatenate([unplanes(b, np.uint32) for b in table.column("times").to_pylist()])
    _, back = np.unique(np.concatenate(blobs), return_inverse=True)
    level = _level(np.bincount(back, times))[back]
    ends = np.cumsum([len(b) for b in blobs]).tolist()
    levels = [level[e - len(b) : e].tobytes() for b, e in zip(blobs, ends)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "levels": pa.array(levels, pa.binary())})


_LISTS = ["keys", "owner", "place", "set", "size", "cold", "cool"]
_TIE = 1 << 30  # counts as agreement enough, whatever a pair needs


def _two_bands(theta: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bands of sizes up to this one: (least size, groups, how many twos partners agree on at least).  Partners lie in one band or
    in two that are neighbours, and meet in the lower one.  A band of 0 groups has n-grams by themselves."""
    edges = [1]
    while edges[-1] <= size:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] / theta)))
    edges = np.array(edges, np.int64)
    both = np.ceil(2 * theta / (1 + theta) * edges - 1e-9).astype(np.int64)  # of the smallest partners
    groups = np.maximum(1, np.round((1 - theta) * edges).astype(np.int64))  # which takes the fewest twos
    agree = 1 + groups // 8
    over = groups + agree > both
    return edges, np.where(over, both - 1, groups), np.where(over, 1, agree)


def _twos(theta: float, some: np.ndarray, sizes: np.ndarray, begin: np.ndarray, g: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, set, band) of the twos of these sets, whose n-grams are in order: keys are of two n-grams of one group.

    In a band of ``groups``, partners have ``groups + agree`` n-grams in common among the first ones of both (``_brought_together``),
    so on ``agree`` twos of these they agree at least.
    """
    none = np.zeros(0, np.int64)
    if not len(some):
        return none.astype(U64), none, none
    edges, groups, agree = _two_bands(theta, int(sizes[some].max()))
    band = np.searchsorted(edges, sizes[some], "right") - 1
    low = band > 0
    own, band = np.concatenate([some, some[low]]), np.concatenate([band, band[low] - 1])
    n = sizes[own]
    both = np.ceil(theta / (1 + theta) * (n + np.maximum(np.ceil(theta * n - 1e-9), edges[band])) - 1e-9).astype(np.int64)
    depth = np.clip(n - both + (groups + agree)[band], 0, n)
    which = np.repeat(np.arange(len(own)), depth)
    at = np.repeat(begin[own] - (np.cumsum(depth) - depth), depth) + np.arange(len(which))
    shared = level[at] > 1  # others no partner has, though they have their places
    which, x = which[shared], mix(g[at[shared]])
    m = groups[band[which]]
    spot = (which << 32) + ((x >> U64(32)) * m.astype(U64) >> U64(32)).astype(np.int64)
    order = np.argsort(spot, kind="stable")
    spot, x, which, m = spot[order], x[order], which[order], m[order]
    salt = mix(np.arange(1, len(edges) + 1).astype(U64) + U64(0x7E57))
    i = np.flatnonzero(m == 0)
    keys, sets, lag = [x[i] + salt[band[which[i]]]], [which[i]], 0
    i = np.flatnonzero(m > 0)
    while len(i):
        lag += 1
        i = i[i + lag < len(spot)]
        i = i[spot[i + lag] == spot[i]]
        keys.append(x[i] + x[i + lag] + salt[band[which[i]]])
        sets.append(which[i])
    which = np.concatenate(sets)
    return mix(np.concatenate(keys)) & _KEY, own[which], band[which]


def _lists(theta: float, n: int, n_buckets: int, hot: int, most: int):
    """Lists of a chunk's sets: blobs by bucket and tier, and in bucket -1 the nodes, of which the k-th has the number k.

    A set orders its n-grams by (sets that have it, hash).  ``cold`` of them are in at most ``hot`` sets, ``cool`` in at most ``most``.
    Tier 2 has bands as places.
    """

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("chunk", pa.int32()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in _LISTS])})
        nodes, sizes, g, keys, back = _chunk_sets(table, n)
        chunk = table.column("chunk")[0].as_py()
        levels = counts.column("levels").take(pc.sort_indices(counts.column("bucket"))).to_pylist()
        level = np.frombuffer(b"".join(levels), np.uint8)[back]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = _ordered(owner, level.astype(np.int64), g)
        level, key = level[order], keys[back[order]]
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cold, cool = (np.bincount(owner, level <= _level(x), len(sizes)).astype(np.int64) for x in (hot, most))
        least = np.ceil(theta * sizes - 1e-9).astype(np.int64)
        first = sizes - least + 1
        depth = first + np.floor(_AGREE * least + 1e-9).astype(np.int64)
        shared = (level > 1) & (place < depth[owner])
        tiers = (
            shared & (level <= _level(hot)),
            shared & (level <= _level(most)) & (cold < first)[owner],
        )
        tiers = [(key[some], owner[some], place[some]) for some in tiers]
        tiers.append(_twos(theta, np.flatnonzero(cool < first), sizes, np.cumsum(sizes) - sizes, g[order], level))
        rows = {k: [] for k in ["chunk", "bucket", *_LISTS]}
        for tier, entries in enumerate(tiers):
            by = np.argsort(entries[0], kind="stable")
            keys_of, set_of, place_of = (v[by] for v in entries)
            cuts = bucket_cuts(keys_of, n_buckets)
            for b in np.flatnonzero(np.diff(cuts)):
                x = slice(cuts[b], cuts[b + 1])
                used, at = np.unique(set_of[x], return_inverse=True)
                of = (used.astype(np.uint32), *(v[used].astype(np.int32) for v in (sizes, cold, cool)))
                blob = (pack_sorted(keys_of[x]), planes(at.astype(np.uint32)), planes(place_of[x].astype(np.int32)), *map(planes, of))
                for name, v in zip(rows, (chunk, tier * n_buckets + int(b), *blob)):
                    rows[name].append(v)
        for name, v in zip(rows, (chunk, -1, planes(nodes.view(U64)), *[b""] * 6)):
            rows[name].append(v)
        return pa.table({k: pa.array(v, pa.int32() if k in ("chunk", "bucket") else pa.binary()) for k, v in rows.items()})

    return run


def _brought_together(theta: float, n_buckets: int, most: int):
    """Of a bucket: pairs of sets, on how many n-grams they agree there, and on how many they must in all.

    Partners have at least ``both`` n-grams in common.  Of each, all but ``size - both + k`` of its first n-grams are too few to
    hold more than ``both - k`` common ones, so among the first ones of both are k at least: only these count, and k of them
    are asked for.  Tier 0 holds n-grams that few sets have.  Of these, partners have ``cold - size + both`` in common, if that
    is less; pairs of which it is less than 1 either way meet in tier 1, where lists are longer.  Pairs of which it is less
    than 1 there too meet in tier 2.  Its lists are of two n-grams each (``_twos``), of any number of sets, which few strangers share.  Sets of lists of over ``most`` are tied there, if they can be such a pair.
    """
    share = theta / (1 + theta)

    def run(table: pa.Table) -> pa.Table:
        tier = table.column("bucket")[0].as_py() // n_buckets
        cols = {c: table.column(c).to_pylist() for c in _LISTS}
        key = np.concatenate([unpack_sorted(b) for b in cols["keys"]])
        place = np.concatenate([unplanes(b, np.int32) for b in cols["place"]])
        base, own, of = 0, [], {k: [] for k in _LISTS[3:]}
        for i, (chunk, o) in enumerate(zip(table.column("chunk").to_pylist(), cols["owner"])):
            own.append(unplanes(o, np.uint32).astype(np.int64) + base)
            of["set"].append(unplanes(cols["set"][i], np.uint32).astype(np.int64) + (chunk << 32))
            for k in _LISTS[4:]:
                of[k].append(unplanes(cols[k][i], np.int32).astype(np.int64))
            base += len(of["set"][-1])
        own = np.concatenate(own)
        name, size, cold, cool = (np.concatenate(v) for v in of.values())
        twin = np.sort(key)
        twin = np.unique(twin[1:][twin[1:] == twin[:-1]])
        some = np.flatnonzero(twin[np.minimum(np.searchsorted(twin, key), len(twin) - 1)] == key) if len(twin) else np.zeros(0, np.int64)
        some = some[np.lexsort((name[own[some]], key[some]))]
        key, place, own = key[some], place[some].astype(np.int64), own[some]
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if len(key) else np.zeros(0, np.int64)
        done: list[tuple] = [(np.zeros(0, np.int64),) * 4]
        many = np.bincount(group)[group] if len(key) else group
        long = np.flatnonzero(many > most) if tier == 2 else many[:0]
        if len(long):
            listed, in_list = own[long], group[long]
            # the largest partner for which shorter lists may not do; of two such sets, one at least allows partners of its own size
            reach = np.floor((size - cool) / share - size + 1e-6).astype(np.int64)[listed]
            n, wide = size[listed], 1 << 32
            even = np.flatnonzero(reach >= n)
            even = even[np.lexsort((n[even], in_list[even]))]
            best = np.maximum.accumulate(in_list[even] * wide + reach[even])
            at = np.searchsorted(in_list[even] * wide + n[even], in_list * wide + np.maximum(reach, 0), "right") - 1
            tied = np.flatnonzero((at >= 0) & (best[at] >= in_list * wide + n)) if len(even) else even
            if len(tied):
                begins = np.concatenate([[True], in_list[tied][1:] != in_list[tied][:-1]])
                hub = tied[begins][np.cumsum(begins) - 1]
                a, b = name[listed[hub]], name[listed[tied]]
                links = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
                done.append((links[0], links[1], np.zeros(links.shape[1], np.int64), np.full(links.shape[1], _TIE)))
            short = np.flatnonzero(many <= most)
            key, place, own, group = key[short], place[short], own[short], group[short]
        edges, _, agree = _two_bands(theta, int(size.max()) if len(size) else 1)

        def settle(parts):
            a, b, need, agreed = (np.concatenate(v) for v in zip(*parts))
            order = np.lexsort((b, a))
            a, b, need, agreed = a[order], b[order], need[order], agreed[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            return a[new], b[new], need[new], np.add.reduceat(agreed, new) if len(a) else agreed

        held = 0
        for start in range(0, len(key), 1 << 17):
            i, lag = np.arange(start, min(len(key), start + (1 << 17))), 0
            while True:
                lag += 1
                i = i[i + lag < len(key)]
                i = i[group[i + lag] == group[i]]
                if not len(i):
                    break
                x, y = own[i], own[i + lag]
                n, m = size[x], size[y]
                both = np.ceil(share * (n + m) - 1e-9).astype(np.int64)
                k = 1 + np.floor(_AGREE * both + 1e-9).astype(np.int64)
                sure = np.maximum(cold[x] - n, cold[y] - m) + both
                fits = (np.minimum(n, m) >= theta * np.maximum(n, m) - 1e-9) & (x != y)
                if tier == 2:
                    band = np.searchsorted(edges, np.minimum(n, m), "right") - 1
                    fits &= (place[i] == band) & (np.maximum(cool[x] - n, cool[y] - m) + both < 1)
                    k = sure = agree[band]
                else:
                    fits &= (place[i] < n - both + k) & (place[i + lag] < m - both + k)
                    if tier == 1:
                        fits &= sure < 1
                        sure = np.maximum(cool[x] - n, cool[y] - m) + both
                    fits &= sure >= 1
                f = np.flatnonzero(fits)
                if len(f):
                    done.append((name[x[f]], name[y[f]], np.minimum(k, sure)[f], np.ones(len(f), np.int64)))
                    held += len(f)
                if held > 1 << 20:
                    done = [settle(done)]
                    held = 0
        done = [settle(done)]
        a, b, need, agreed = (np.concatenate(v) for v in zip(*done))
        return pa.table({"a": a, "b": b, "need": pa.array(need.astype(np.int32)), "agreed": pa.array(agreed.astype(np.int32))})

    return run


def _listed_pairs(docs: DataFrame, n_bytes: int, theta: float, n: int, hot: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(a, b: pairs of sets that may be partners, or ties; set, node: whose they are)."""
    n_chunks, n_buckets = max(1, n_bytes // CHUNK_BYTES), max(1, n_bytes // BUCKET_BYTES)
    texts = _distinct_texts(docs).withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(n_chunks)).cast("int"))
    counts = texts.groupBy("chunk").applyInArrow(tidy(_chunk_counts(n, n_buckets)), "chunk int, bucket int, keys binary, times binary")
    counts = counts.groupBy("bucket").applyInArrow(tidy(_bucket_counts), "chunk int, bucket int, levels binary")
    lists = texts.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(tidy(_lists(theta, n, n_buckets, hot, most)), "chunk int, bucket int, " + ", ".join(f"{c} binary" for c in _LISTS))
    lists = stage_table(lists, "lists", free=True)
    pairs = lists.filter("bucket >= 0").groupBy("bucket").applyInArrow(tidy(_brought_together(theta, n_buckets, most)), "a long, b long, need int, agreed int")
    pairs = pairs.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("agreed").alias("agreed")).filter("agreed >= need").select("a", "b")
    links = stage_table(pairs, "candidates", free=True)

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("keys").to_pylist()):
                nodes = unplanes(blob, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(nodes)) + (chunk << 32)), pa.array(nodes)], names=["set", "node"])

    sets = stage_table(lists.filter("bucket = -1").select("chunk", "keys").mapInArrow(run, "set long, node long"), "sets")
    drop_staged(lists)
    return links, sets


def candidate_components(docs: DataFrame, n_bytes: int, theta: float = THETA, n: int = N, hot: int = HOT, most: int = CROWD) -> DataFrame:
    """node (of ``text_keys``), component: every pair of at least theta lies in one component.

    Pairs that agree on less weight than their rooms ask for are dropped.
    """
    words, bits, n_docs = word_bits(docs)
    plan = Plan(words, bits, n_docs, theta)
    plan.reach(1 << 16)
    for band in range(len(plan.his)):
        plan.scheme(band)
    if not any(plan.scheme(band)[1] for band, hi in enumerate(plan.his) if hi > _TINY):
        links, sets = _listed_pairs(docs, n_bytes, theta, n, hot, most)
        tied = stage_table(components(links).withColumnRenamed("node", "set").join(sets, "set").select("node", "component"), "tied", free=True)
        drop_staged(links)
        drop_staged(sets)
        return tied
    n_buckets = max(1, n_bytes // BUCKET_BYTES)
    blobs = docs.select("text").mapInArrow(tidy(_index(plan, n, n_buckets)), "bucket int, " + ", ".join(f"{c} binary" for c in _BLOB))
    met = blobs.groupBy("bucket").applyInArrow(tidy(_meet(hot, theta)), "hot boolean, a long, b long, space int, agreed int, floor_a int, floor_b int")
    met = stage_table(met, "agreements", free=True)
    again, loss, stars = _crowded(met, theta, most)
    loss = stage_table(loss, "losses", free=True)
    # by a, so that counting, the losses of a and a first cut need one exchange
    pairs = met.filter("not hot").drop("hot").unionByName(again).repartition("a", "space")
    pairs = pairs.groupBy("a", "b", "space").agg(F.sum("agreed").alias("agreed"), F.max("floor_a").alias("floor_a"), F.max("floor_b").alias("floor_b"))
    for side in "ab":
        less = loss.select(F.col("node").alias(side), "space", *[F.col(c).alias(c + side) for c in ("loss", "dense", "over")])
        pairs = pairs.join(less, [side, "space"], "left").filter(F.col("agreed") >= F.col(f"floor_{side}") - F.coalesce(f"loss{side}", F.lit(0)))
    both = F.coalesce(F.col("densea") & F.col("denseb"), F.lit(False))
    floors = [F.col(f"floor_{x}") - F.coalesce(F.when(both, F.col(f"over{x}")).otherwise(F.col(f"loss{x}")), F.lit(0)) for x in "ab"]
    edges = pairs.filter(F.col("agreed") >= F.greatest(*floors)).select("a", "b")
    links = stage_table(edges.unionByName(stars).filter("a <> b").distinct(), "candidates", free=True)
    tied = components(links)
    drop_staged(met)
    drop_staged(loss)
    return tied


# ---------------------------------------------------------------- verification


def _overlaps(sets: list[np.ndarray], theta: float, across: int | None):
    """Yields (i, j) of all pairs i < j of sorted sets that reach theta, some at a time; with ``across``, only i < across <= j."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    token = token.astype(np.int32)
    # rarest first; partners share one of the first |s| - ceil(theta |s|) + 1
    rank = np.empty(len(df), np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    table = np.sort(owner.astype(np.int64) * len(df) + rank[token])
    o, r = (table // len(df)).astype(np.int32), (table % len(df)).astype(np.int32)
    begin = np.cumsum(sizes) - sizes
    head = np.arange(len(r)) - begin[o] < (sizes - np.ceil(theta * sizes - 1e-9) + 1)[o]
    lists = np.sort(r[head].astype(np.int64) * n + o[head])  # by n-gram, then by set
    who, new = (lists % n).astype(np.int32), np.flatnonzero(np.diff(lists // n, prepend=-1))
    later = np.repeat(np.append(new[1:], len(lists)), np.diff(np.append(new, len(lists)))) - np.arange(len(lists)) - 1
    entries = np.argsort(who, kind="stable")
    first = np.searchsorted(who[entries], np.arange(n + 1))
    cost = np.concatenate([[0], np.cumsum(later[entries])])[first]  # pairs met by the sets before
    # seconds either way, roughly: all against all by products of matrices, or what the lists bring together one by one
    shared = df > 1
    if float(n) * n * shared.sum() * 3e-11 <= 6e-8 * (float(cost[-1]) + min(float(cost[-1]), n * n / 2) * float(sizes.mean())):
        yield from _tiles(np.cumsum(shared) - 1, shared, token, begin, sizes, theta, across)
        return
    x = 0
    while x < n:
        y = max(x + 1, int(np.searchsorted(cost, cost[x] + _STEP, "right")) - 1)
        at = entries[first[x] : first[y]]
        k = later[at]
        partner = who[np.repeat(at + 1 - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        met = np.unique(np.repeat(who[at], k).astype(np.int64) * n + partner)
        i, j = met // n, met % n
        keep = np.minimum(sizes[i], sizes[j]) >= theta * np.maximum(sizes[i], sizes[j]) - 1e-9
        if across is not None:
            keep &= (i < across) & (j >= across)
        i, j = i[keep], j[keep]
        total = np.concatenate([[0], np.cumsum(sizes[i])])
        p = 0
        while p < len(i):  # about a million n-grams at once
            q = max(p + 1, int(np.searchsorted(total, total[p] + _STEP, "right")) - 1)
            a, b = i[p:q], j[p:q]
            k = sizes[a]
            pair = np.repeat(np.arange(len(a)), k)
            want = r[np.repeat(begin[a] - (np.cumsum(k) - k), k) + np.arange(len(pair))] + b[pair] * np.int64(len(df))
            found = table[np.minimum(np.searchsorted(table, want), len(table) - 1)] == want
            got = np.bincount(pair, found, len(a)).astype(np.int64)
            good = got >= theta * (k + sizes[b] - got) - 1e-9
            if good.any():
                yield a[good], b[good]
            p = q
        x = y


def _tiles(column, shared, token, begin, sizes, theta: float, across: int | None, tile: int = 1024):
    """What ``_overlaps`` yields, by products of 0/1 matrices of ``tile`` sets each, some thousand n-grams at a time."""
    n, width = len(sizes), int(shared.sum())

    def part(a: int):
        b = min(n, a + tile)
        t = token[begin[a] : begin[b - 1] + sizes[b - 1]]
        row = np.repeat(np.arange(b - a), sizes[a:b])[shared[t]]
        c = column[t[shared[t]]]
        order = np.argsort(c, kind="stable")
        return b - a, row[order], c[order]

    def block(rows: int, row: np.ndarray, c: np.ndarray, at: int, to: int) -> np.ndarray:
        p, q = np.searchsorted(c, [at, to])
        out = np.zeros((rows, to - at), np.float32)
        out[row[p:q], c[p:q] - at] = 1
        return out

    for a in range(0, n if across is None else across, tile):
        left = part(a)
        for b in range(a if across is None else max(a, across // tile * tile), n, tile):
            right = left if b == a else part(b)
            inter = np.zeros((left[0], right[0]), np.float32)
            for at in range(0, width, 4096):
                to = min(width, at + 4096)
                x = block(*left, at, to)
                inter += x @ (x if b == a else block(*right, at, to)).T
            for k in range(left[0]):
                i, j = a + k, np.arange(b, b + right[0])
                got = inter[k].astype(np.int64)
                good = (got > 0) & (got >= theta * (sizes[i] + sizes[j] - got) - 1e-9) & (j > i)
                if across is not None:
                    good &= (i < across) & (j >= across)
                if good.any():
                    yield np.full(int(good.sum()), i), j[good]


def _linked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of what each node is connected with, by these links and by those that ``label`` stands for."""
    i, j = np.concatenate([i, np.arange(len(label))]), np.concatenate([j, label])
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(theta: float, n: int):
    """Of a bin of (part of) components: how many rows each node is linked with there, and a node that links lead to."""

    def run(table: pa.Table) -> pa.Table:
        where = np.stack([table.column(c).to_numpy() for c in ("component", "p", "q")], axis=1)
        _, which = np.unique(where, axis=0, return_inverse=True)
        which = which.ravel()
        block = table.column("block").to_numpy()
        node = table.column("node").to_numpy()
        order = np.lexsort((node, block, which))
        table = table.take(pa.array(order))
        where, block, which, node = where[order], block[order], which[order], node[order]
        copies = table.column("copies").to_numpy()
        bounds = np.flatnonzero(np.diff(np.concatenate([[-1], which, [which.max() + 1]]))).tolist() if len(which) else []
        held = np.concatenate([[0], np.cumsum(pc.binary_length(table.column("text")).fill_null(0).to_numpy().astype(np.int64))])
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        sets: list[np.ndarray] = []  # of the rows so far
        for s, e in zip(bounds, bounds[1:]):
            while len(sets) < e:  # n-grams of some MB of text at once
                base = len(sets)
                end = max(base + 1, int(np.searchsorted(held, held[base] + _STEP, "right")) - 1)
                g, off = ngram_sets(table.column("text").slice(base, end - base), n)[:2]
                sets += [g[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            p, q = where[s, 1], where[s, 2]
            across = None if p == q else int(np.searchsorted(block[s:e], p, "right"))
            links, label = np.zeros(e - s, np.int64), np.arange(e - s)
            held_i, held_j, much = [], [], 0
            for i, j in _overlaps(sets[s:e], theta, across):
                links += np.bincount(i, copies[s:e][j], e - s).astype(np.int64) + np.bincount(j, copies[s:e][i], e - s).astype(np.int64)
                held_i.append(i), held_j.append(j)
                much += len(i)
                if much > _STEP:
                    label, held_i, held_j, much = _linked(label, np.concatenate(held_i), np.concatenate(held_j)), [], [], 0
            if much:
                label = _linked(label, np.concatenate(held_i), np.concatenate(held_j))
            sets[s:e] = [None] * (e - s)
            some = np.flatnonzero(links)
            for k, v in enumerate((node[s:e][some], links[some], node[s:e][label[some]])):
                out[k].append(v)
        return pa.table({k: pa.array(np.concatenate(v)) for k, v in zip(("node", "links", "to"), out)})

    return run


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), node, words: of each row."""

    def run(batches):
        for batch in batches:
            _, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, _STEP):
                part = batch.slice(i, j - i)
                data, off = string_buffers(part.column("text"))
                h, _, _, tok = hash_tokens(data, off, "word")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(text_keys(h, tok)), pa.array(np.diff(tok), pa.int64())], names=["doc_id", "th", "node", "words"]
                )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(tidy(run), "doc_id long, th long, node long, words long")


def _one_text_each(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """wanted (with doc_id and th) with the text of such a row.  Merged at any size, so that small tables tell what large ones take."""
    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"), "text").hint("merge")
    found = wanted.join(texts, wanted["doc_id"].eqNullSafe(texts["__id"]) & (wanted["th"] == texts["__th"])).drop("__id", "__th", "doc_id", "th")
    return found.dropDuplicates(["node"]) if repeated else found


def _rounds(held: dict[int, int], limit: int) -> list[tuple[int, int]]:
    """Ranges of turns, each of which sends texts of at most ``limit`` words, or is one turn.  ``held``: words of the components
    by their number of blocks; in every turn below that number each of their texts is sent once."""
    out, start, sent = [], 0, 0
    for turn in range(max(held, default=1)):
        words = sum(w for b, w in held.items() if b > turn)
        if turn > start and sent + words > limit:
            out.append((start, turn))
            start, sent = turn, 0
        sent += words
    return [*out, (start, max(held, default=1))]


def _found(each: DataFrame, theta: float, n: int, bins: int, turns: tuple[int, int]) -> DataFrame:
    """``_verify`` of the pairs of blocks p, q that meet in these turns, (p + q) modulo the number of blocks: in a turn a block
    meets one other, or itself."""
    each = each.filter(F.col("blocks") > turns[0])
    each = each.withColumn("turn", F.explode(F.sequence(F.lit(turns[0]), F.least(F.lit(turns[1]), "blocks") - 1)))
    other = F.pmod(F.col("turn") - F.col("block"), F.col("blocks"))
    each = each.withColumn("p", F.least("block", other)).withColumn("q", F.greatest("block", other)).drop("turn", "blocks")
    spot = F.pmod(F.xxhash64("component", "p", "q"), F.lit(bins))
    return stage_table(each.groupBy(spot.alias("bin")).applyInArrow(tidy(_verify(theta, n)), "node long, links long, to long"), "found", free=True)


def groups(docs: DataFrame, theta: float = THETA, n: int = N, hot: int = HOT, block: int = BLOCK, most: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, th, node, words; nodes with a link: node, copies, links, lead).

    ``copies``: rows of the node.  ``links``: rows of other nodes that are similar to it.  ``lead``: the least (doc_id, th) of
    the group, null ids last.  A component of more than ``block`` words is verified in pairs of blocks, in so many rounds that
    each sends no more than all words of docs, or every text of a component once.
    """
    rows = stage_table(_members(docs), "rows", free=True)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    nodes = rows.filter("words > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("least"), F.max("words").alias("words"))
    nodes = stage_table(nodes, "nodes", free=True)
    repeated = not nodes.filter("copies > 1").isEmpty()
    n_bytes = text_bytes(docs)
    parts = candidate_components(docs, n_bytes, theta, n, hot, most).join(nodes, "node")
    parts = stage_table(parts.select("node", "component", "copies", "words", "least.doc_id", "least.th"), "parts", free=True)
    count = parts.groupBy("component").agg(F.sum("words").alias("held")).withColumn("blocks", F.ceil(F.col("held") / block).cast("int"))
    each = parts.join(count.drop("held"), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = _one_text_each(docs, each.drop("words"), repeated)
    bins = max(1, n_bytes // BIN_BYTES)
    held = {r["blocks"]: r["held"] for r in count.groupBy("blocks").agg(F.sum("held").alias("held")).collect()}
    rounds = _rounds(held, nodes.agg(F.sum("words").alias("n")).first()["n"] or 0)
    if len(rounds) > 1:
        each = stage_table(each, "texts", free=True)
    found = reduce(DataFrame.unionByName, [_found(each, theta, n, bins, turns) for turns in rounds])
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    of = nodes.join(links, "node", "left").join(tied, "node", "left").filter("copies > 1 or links > 0")
    of = of.select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"), "least")
    lead = of.groupBy("component").agg(F.min("least").alias("lead"))
    linked = stage_table(of.join(lead, "component").select("node", "copies", "links", "lead"), "linked", free=True)
    for x in (parts, found, nodes, *[each] * (len(rounds) > 1)):
        drop_staged(x)
    return rows, linked


def similar(docs: DataFrame, theta: float = THETA, n: int = N, hot: int = HOT, block: int = BLOCK, most: int = CROWD) -> DataFrame:
    """doc_id, class_id, n_links: one row for each row of docs.

    A row is linked with every other row whose set of n-grams has a Jaccard similarity of at least theta; ``n_links`` counts
    them, copies included.  Links connect classes; ``class_id`` is the least id in the class.

    n-grams are of words: runs of letters, digits and non-ASCII characters, ASCII letters lower-cased.  A text of fewer than
    n words has one n-gram, all its words.  A null text or one without words has no link and its own id as class; so has a row
    that nothing is similar to.  Repeated rows are rows like others, also under one id; a null id is an id unknown, so a class
    of such rows alone has a null class_id.  Other columns are not read.  n-grams and texts are told apart by 64-bit hashes.
    """
    rows, linked = groups(docs.select("doc_id", "text"), theta, n, hot, block, most)
    found = rows.filter("words > 0").join(linked, "node", "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long")
    found = found.select("doc_id", F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"), n_links.alias("n_links"))
    return found.unionByName(rows.filter("words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, theta: float = THETA, n: int = N, hot: int = HOT, block: int = BLOCK, most: int = CROWD) -> DataFrame:
    """Rows of docs with one row of each class of ``similar``: the one of the least id (null ids last), then of the least hash
    of the text, and of rows equal in both the one whose columns written as JSON come first.

    Rows with a null text or no words all stay.  Unlike texts of one id are rows like others.
    Names beginning with two underscores are ours.
    """
    rows, linked = groups(docs.select("doc_id", "text"), theta, n, hot, block, most)
    away = rows.filter("words > 0").join(linked.select("node", "lead"), "node")
    away = away.filter(~(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("th") == F.col("lead.th")))).select(F.col("doc_id").alias("__id"), F.col("th").alias("__at")).distinct()
    mine = docs.withColumn("__th", F.xxhash64("text"))
    kept = mine.join(away, mine["doc_id"].eqNullSafe(away["__id"]) & (mine["__th"] == away["__at"]), "left_anti")
    twice = stage_table(rows.filter("words > 0").groupBy("doc_id", "th").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__at")), "repeated")
    if twice.isEmpty():
        return kept.drop("__th")
    same = kept["doc_id"].eqNullSafe(twice["__id"]) & (kept["__th"] == twice["__at"])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(twice, same, "left_semi").groupBy("doc_id", "__th").agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return kept.join(twice, same, "left_anti").drop("__th").unionByName(one.select("__row.*"))


def oracle(theta: float = THETA) -> str:
    """DuckDB SQL for ``similar`` with bigrams over documents, by counting common bigrams of all pairs and following links."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS tok
  FROM documents
), s AS (
  SELECT r, CASE WHEN len(tok) = 1 THEN [tok[1]] ELSE list_distinct([tok[i] || ' ' || tok[i + 1] for i in range(1, len(tok))]) END AS grams
  FROM d WHERE len(tok) > 0
), g AS (
  SELECT r, len(grams) AS n, unnest(grams) AS gram FROM s
), common AS (
  SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM g a JOIN g b ON a.gram = b.gram AND a.r < b.r AND a.n >= {theta} * b.n AND b.n >= {theta} * a.n
  GROUP BY 1, 2, 3, 4
), pair AS (
  SELECT a, b FROM common WHERE k >= {theta} * (na + nb - k) - 1e-9
), link AS (
  SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (
  SELECT r, r AS x FROM d
  UNION
  SELECT reach.r, link.b FROM reach JOIN link ON reach.x = link.a
), class AS (
  SELECT reach.r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.x GROUP BY 1
), degree AS (
  SELECT a, count(*) AS n FROM link GROUP BY 1
)
SELECT d.doc_id, class_id, coalesce(degree.n, 0)::BIGINT AS n_links FROM d JOIN class USING (r) LEFT JOIN degree ON degree.a = d.r
"""
