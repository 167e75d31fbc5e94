"""SentencePiece merge-type (BPE) models: exact encoding by backtracking, and decoding.

A text is cut where a merge can never reach: before each run of word marks (no piece of the vocabulary holds a mark after
another character; this is checked when a model is loaded), around line feeds when these are no piece, and between
characters that are neighbours in no piece (as a letter and a comma).  Each segment is encoded by taking, from left to right, the longest piece found by an Aho-Corasick pass whose neighbour is compatible with
it, i.e. re-merging both pieces' characters gives the same two pieces; dead ends are kept in a bitfield and the search
steps back.  Segments that hold a run of marks are re-merged as a whole, because the run's pieces tie on score.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np

from .common import KEPT, hash_tokens

MARK = "▁"
_SLOW = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
_SLOW_NO_LF = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = s = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << s
        if c < 128:
            return x, i
        s += 7


def _fields(b: bytes):
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            v, i = b[i : i + 4], i + 4
        yield key >> 3, v


class MergeModel:
    """A SentencePiece model file of type BPE with byte fallback and no normalisation."""

    #: Segments, words and fits of pieces that are remembered, of each; and distinct segments in the numpy store.
    FITS, WORDS, STORE = 200_000, 200_000, 1_000_000

    def __init__(self, blob: bytes, cache_size: int = 20_000):
        self.digest = hashlib.sha256(blob).hexdigest()
        pieces: list[tuple[str, float, int]] = []
        spec: dict = {"dummy": True, "squeeze": True, "rules": b"", "type": 1}
        for f, v in _fields(blob):
            if f == 1:
                p = {1: b"", 2: np.float32(0), 3: 1}
                for g, w in _fields(v):
                    p[g] = w
                score = float(np.frombuffer(p[2], "<f4")[0]) if isinstance(p[2], bytes) else 0.0
                pieces.append((p[1].decode(), score, p[3]))
            elif f == 2:
                for g, w in _fields(v):
                    if g == 3:
                        spec["type"] = w
            elif f == 3:
                for g, w in _fields(v):
                    if g == 3:
                        spec["dummy"] = bool(w)
                    elif g == 4:
                        spec["squeeze"] = bool(w)
                    elif g == 2:
                        spec["rules"] = w
        if spec["type"] != 2 or spec["squeeze"] or spec["rules"] or not spec["dummy"]:
            raise ValueError("expected a BPE model with dummy prefix, kept white space and no normalisation rules")
        self.pieces = [p for p, _, _ in pieces]
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_ids = [0] * 256
        out: list[bytes] = []
        for i, (p, s, kind) in enumerate(pieces):
            if kind == 6:
                self.bytes_ids[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            elif kind == 1:
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} crosses a word mark")
                self.ids[p], self.score[p] = i, s
                out.append(p.replace(MARK, " ").encode())
            elif kind in (2, 3):
                out.append(b" \xe2\x81\x87 " if kind == 2 else b"")
            else:
                raise ValueError(f"piece type {kind} is not supported")
        self.out = out
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.dtype = np.dtype("<u2") if len(pieces) <= 1 << 16 else np.dtype("<u4")
        self.split_lf = not any("\n" in p for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.part = re.compile(self._parts())
        self.raw = {p: np.array([i], self.dtype).tobytes() for p, i in self.ids.items()}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_size = cache_size
        self._forget()
        self.lockstep = Lockstep(self)

    def _forget(self) -> None:
        """Empties the store of segments: their hashes in order, where their ids begin in ``store_ids``, and how many."""
        self.store_keys, self.store_ids = np.zeros(0, np.uint64), np.zeros(0, self.dtype)
        self.store_start, self.store_size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _parts(self) -> str:
        """Pattern of the parts of a segment: the largest set of characters linked by adjacency in pieces, or the rest."""
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for p in self.ids:
            q = p.lstrip(MARK)
            for a, b in zip(q, q[1:]):
                root[find(a)] = find(b)
        sets: dict[str, list[str]] = {}
        for c in root:
            sets.setdefault(find(c), []).append(c)
        most = "".join(re.escape(c) for c in sorted(max(sets.values(), key=len, default=["a"])))
        return f"{MARK}*(?:[{most}]+|[^{most}{MARK}]+)|{MARK}+"

    # -- encoding

    def remerge(self, chars: list[str]) -> list[str]:
        """The model's own procedure: merge the best-scored adjacent pair, leftmost among equals, until none is left."""
        score = self.score
        n = len(chars)
        if n > 200:
            return self._remerge_heap(chars)
        parts = list(chars)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _remerge_heap(self, chars: list[str]) -> list[str]:
        score, parts = self.score, list(chars)
        n = len(parts)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n:
                p = parts[i] + parts[j]
                s = score.get(p)
                if s is not None:
                    heapq.heappush(heap, (-s, i, p, j))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, p, j = heapq.heappop(heap)
            if parts[i] is None or j != nxt[i] or parts[j] is None or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [p for p in parts if p is not None]

    def _fit(self, a: str, b: str) -> bool:
        if self.n_fits > self.FITS:
            self.fits.clear()
            self.n_fits = 0
        self.n_fits += 1
        ok = self.fits.setdefault(a, {})[b] = self.remerge(list(a + b)) == [a, b]
        return ok

    def segment_pieces(self, seg: str) -> list[str]:
        """Pieces (or single unknown characters) of one segment, by backtracking."""
        if MARK * 2 in seg:
            return self.remerge(list(seg))
        n = len(seg)
        found: list[list[int]] = [[1] for _ in range(n)]  # lengths of the pieces that begin at each place, ascending
        for end, size in self.automaton.iter(seg):
            found[end - size + 1].append(size)
        fits, fit, none = self.fits, self._fit, {}
        failed = 0  # bit p: no way to finish from place p
        pos, out, step = 0, [], []
        k = len(found[0]) - 1 if n else 0
        while pos < n:
            here = found[pos]
            last = out[-1] if out else None
            known = fits.get(last, none)
            while k >= 0:
                end = pos + here[k]
                if not failed >> end & 1:
                    piece = seg[pos:end]
                    if last is None:
                        break
                    ok = known.get(piece)
                    if ok is None:
                        ok = fit(last, piece)
                    if ok:
                        break
                k -= 1
            if k >= 0:
                out.append(piece)
                step.append((pos, k))
                pos = end
                if pos < n:
                    k = len(found[pos]) - 1
            else:
                failed |= 1 << pos
                out.pop()
                pos, k = step.pop()
                # the piece tried at pos now ends at a failed place, so the next shorter one is taken
        return out

    def _encode_segment(self, seg: str) -> bytes:
        raw = self.raw
        out = [raw.get(p) or self._unknown(p) for p in self.segment_pieces(seg)]
        return b"".join(out)

    def _unknown(self, char: str) -> bytes:
        return np.array([self.bytes_ids[b] for b in char.encode()], self.dtype).tobytes()

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text or not self.split_lf:
            return (_SLOW if self.split_lf else _SLOW_NO_LF).findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK)).replace("\n", " \n ").split(" ")

    def encode_segments(self, segs: list[str]) -> list[bytes]:
        """Ids of segments.  They are remembered in two generations of bounded size."""
        get = self.cache.get
        parts = list(map(get, segs))
        if None in parts:
            new = {s for s, p in zip(segs, parts) if p is None}
            old, words = self.old, self.words
            local = {s: old[s] for s in new if s in old} if old else {}
            whole = [s for s in new if s not in local]
            split = [[s] if MARK * 2 in s else self.part.findall(s) for s in whole]
            todo = list({w for x in split for w in x if w not in words})
            fresh = dict(zip(todo, self._encode_words(todo)))
            for s, x in zip(whole, split):
                local[s] = b"".join([fresh[w] if w in fresh else words[w] for w in x])
            if len(words) + len(fresh) > self.WORDS:
                words.clear()
            words.update((w, v) for w, v in fresh.items() if len(w) <= 64)
            if len(self.cache) + len(local) > self.cache_size:
                self.old, self.cache = self.cache, {}
            self.cache.update((k, v) for k, v in local.items() if len(k) <= 64)
            parts = [local[s] if p is None else p for s, p in zip(segs, parts)]
        return parts

    def _encode_new(self, segs: list[str]) -> list[bytes]:
        """Ids of distinct segments that the store doesn't have; only their words are remembered."""
        words, find = self.words, self.part.findall
        split = [[s] if MARK * 2 in s else find(s) for s in segs]
        todo = list({w for x in split for w in x if w not in words})
        fresh = dict(zip(todo, self._encode_words(todo)))
        out = [fresh.get(x[0]) or words[x[0]] if len(x) == 1 else b"".join([fresh.get(w) or words[w] for w in x]) for x in split]
        if len(words) + len(fresh) > self.WORDS:
            words.clear()
        words.update((w, v) for w, v in fresh.items() if len(w) <= 64)
        return out

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts end to end, and the rows' offsets in them.

        Texts whose blanks are single are cut into segments by numpy, and each distinct segment is looked up once, in a store
        that outlasts the call; segments are told apart by a 64-bit hash, those of over 64 bytes by their place.  Other texts
        are cut one by one.
        """
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        slow = np.zeros(n, bool)
        if not self.split_lf:
            slow[:] = True
        elif len(data):
            some = np.flatnonzero(sizes > 0)
            slow[some] = data[offsets[some]] == 32
            odd = np.flatnonzero((data[:-1] == 32) & (data[1:] == 32)) + 1
            mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            slow[np.searchsorted(offsets, np.concatenate([odd, mark]), "right") - 1] = True
        out_rows: list[np.ndarray] = []
        counts = np.zeros(n, np.int64)
        order: list[np.ndarray] = []
        fast = np.flatnonzero(~slow & (sizes > 0))
        if len(fast):
            ids, per = self._encode_fast(data, offsets, fast)
            counts[fast] = per
            out_rows.append(ids)
            order.append(np.repeat(fast, per))
        for r in np.flatnonzero(slow & (sizes > 0)).tolist():
            ids = np.frombuffer(b"".join(self.encode_segments(self.segments(data[offsets[r] : offsets[r + 1]].tobytes().decode()))), self.dtype)
            counts[r] = len(ids)
            out_rows.append(ids)
            order.append(np.full(len(ids), r))
        flat = np.concatenate(out_rows) if out_rows else np.zeros(0, self.dtype)
        if len(out_rows) > 1:
            flat = flat[np.argsort(np.concatenate(order), kind="stable")]
        return flat, np.concatenate([[0], np.cumsum(counts)])

    def _encode_fast(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) < len(offsets) - 1:
            size = np.diff(offsets)[rows]
            at = np.repeat(offsets[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            data, offsets = data[at], np.concatenate([[0], np.cumsum(size)])
        h, begin, end, _ = hash_tokens(data, offsets, "blank", ends=True)
        heads = offsets[:-1]
        opens = np.zeros(len(data) + 1, bool)
        opens[heads] = True
        marked = opens[begin] | (data[np.maximum(begin - 1, 0)] == 32)
        key = h ^ np.where(marked, np.uint64(0x9D39247E33776D41), np.uint64(0))
        long = np.flatnonzero(end - begin > 64)
        key[long] = long.astype(np.uint64) | np.uint64(1 << 63)  # a place of its own
        feed = np.flatnonzero(data == 10)
        last = np.zeros(len(data) + 1, bool)
        last[offsets[1:]] = True
        blank = np.flatnonzero(data == 32)
        # a mark that no word follows: a blank before a line feed or the end, or a text that begins with a line feed
        bare = blank[last[blank + 1] | (data[np.minimum(blank + 1, len(data) - 1)] == 10)]
        bare_head = heads[data[heads] == 10]
        place = np.concatenate([begin * 2 + 1, feed * 2 + 1, bare * 2 + 1, bare_head * 2])
        keys = np.concatenate([key, np.full(len(feed), 1, np.uint64), np.full(len(bare) + len(bare_head), 2, np.uint64)])
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        n_words = len(begin)
        lasting = (first >= n_words) | (end[np.minimum(first, n_words - 1)] - begin[np.minimum(first, n_words - 1)] <= 64) if n_words else np.ones(len(first), bool)
        if len(self.store_keys):
            at = np.minimum(np.searchsorted(self.store_keys, unique), len(self.store_keys) - 1)
            hit = lasting & (self.store_keys[at] == unique)
        else:
            at, hit = np.zeros(len(unique), np.int64), np.zeros(len(unique), bool)
        raw = data.tobytes()
        new = np.flatnonzero(~hit)
        some = first[new]
        word = some < n_words
        bs, es, ms = (np.zeros(len(some), x.dtype) for x in (begin, end, marked))
        for to, of in ((bs, begin), (es, end), (ms, marked)):
            to[word] = of[some[word]]
        feeds = n_words + len(feed)
        segs = [
            ((MARK if m else "") + raw[p:q].decode()) if i < n_words else "\n" if i < feeds else MARK for i, p, q, m in zip(some.tolist(), bs.tolist(), es.tolist(), ms.tolist())
        ]
        parts = self._encode_new(segs)
        lens, starts = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        lens[new] = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts[new] = len(self.store_ids) + np.cumsum(lens[new]) - lens[new]
        lens[hit], starts[hit] = self.store_size[at[hit]], self.store_start[at[hit]]
        flat = np.concatenate([self.store_ids, np.frombuffer(b"".join(parts), self.dtype)])
        keep = new[lasting[new]]
        if len(self.store_keys) + len(keep) > self.STORE:
            self._forget()
        else:
            at = np.searchsorted(self.store_keys, unique[keep])
            self.store_keys, self.store_ids = np.insert(self.store_keys, at, unique[keep]), flat
            self.store_start = np.insert(self.store_start, at, starts[keep])
            self.store_size = np.insert(self.store_size, at, lens[keep].astype(np.int32))
        turn = np.argsort(place, kind="stable")
        which = inverse.ravel()[turn]
        k = lens[which]
        ends = np.cumsum(k)
        ids = flat[np.repeat(starts[which] - (ends - k), k) + np.arange(int(k.sum()))]
        row = np.searchsorted(place[turn], offsets * 2)
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[row])

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Segments' ids; all that the dense tables cover go through the search in step."""
        out: list[bytes] = [b""] * len(words)
        fast = []
        for i, w in enumerate(words):
            if 0 < len(w) < 60 and MARK * 2 not in w and self.lockstep.covers(w):
                fast.append(i)
            else:
                out[i] = self._encode_segment(w)
        for a in range(0, len(fast), 20_000):
            some = fast[a : a + 20_000]
            for i, ids in zip(some, self.lockstep.encode([words[i] for i in some])):
                out[i] = ids
        return out

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0].tolist()

    # -- decoding

    def gives_back(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each row whether decoding its ids gives its text (UTF-8 bytes end to end) again."""
        size = self.out_size[ids]
        ends = np.cumsum(size)
        total = np.concatenate([[0], ends])[at]  # where a row's decoded bytes begin
        got = self.out_bytes[np.repeat(self.out_start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        lead = np.zeros(len(at) - 1, np.int64)
        some = np.flatnonzero(np.diff(total) > 0)
        lead[some] = got[total[some]] == 32
        want = np.diff(offsets)
        same = np.diff(total) - lead == want
        rows = np.flatnonzero(same & (want > 0))
        n = want[rows]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = got[np.repeat(total[rows] + lead[rows], n) + step] == data[np.repeat(offsets[rows], n) + step]
        if len(rows):
            same[rows] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same

    def decode(self, ids) -> str:
        """Text of ids.  Of white space only the model's own leading mark goes; malformed UTF-8 becomes U+FFFD."""
        out = self.out
        raw = b"".join([out[i] for i in ids])
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


class Lockstep:
    """The same backtracking for many segments at once: each numpy step advances the search of every segment.

    An Aho-Corasick automaton over the reversed pieces, kept as a dense table for the 127 characters that pieces use
    most, reads each segment from its end; its state at a place gives the longest piece that begins there.
    """

    def __init__(self, model: MergeModel):
        self.model = model
        ids = model.ids
        uses: dict[str, int] = {}
        for p in ids:
            for c in p:
                uses[c] = uses.get(c, 0) + 1
        chars = sorted((c for c in uses if c in ids), key=lambda c: (-uses[c], c))[:127]
        self.chars = frozenset(chars)
        self.code = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(chars):
            self.code[ord(c)] = k + 1
        index = {c: k + 1 for k, c in enumerate(chars)}
        child: list[dict[int, int]] = [{}]
        own = [-1]
        for p, i in ids.items():
            if all(c in index for c in p):
                node = 0
                for c in reversed(p):
                    k = index[c]
                    nxt = child[node].get(k)
                    if nxt is None:
                        nxt = child[node][k] = len(child)
                        child.append({})
                        own.append(-1)
                    node = nxt
                own[node] = i
        n = len(child)
        self.goto = np.zeros((n, 128), np.int32)
        self.best = np.array(own, np.int32)
        fail = np.zeros(n, np.int32)
        layer = [0]
        while layer:
            nxt_layer = []
            for node in layer:
                row = self.goto[node]
                if node:
                    row[:] = self.goto[fail[node]]
                    if self.best[node] < 0:
                        self.best[node] = self.best[fail[node]]
                for k, c in child[node].items():
                    fail[c] = row[k] if node else 0
                    row[k] = c
                    nxt_layer.append(c)
            layer = nxt_layer
        self.size = np.array([len(p) for p in model.pieces], np.int32)
        self.shorter = np.full(len(model.pieces), -1, np.int32)
        for p, i in ids.items():
            for k in range(len(p) - 1, 0, -1):
                j = ids.get(p[:k])
                if j is not None:
                    self.shorter[i] = j
                    break
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.zeros(1 << self.bits, bool)

    def covers(self, seg: str) -> bool:
        return self.chars.issuperset(seg)

    def fits(self, last: np.ndarray, cand: np.ndarray) -> np.ndarray:
        key = (last.astype(np.int64) << 32) | cand
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.vals[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            pieces, memo, fit = self.model.pieces, self.model.fits, self.model._fit
            new, back = np.unique(key[miss], return_inverse=True)
            got = np.zeros(len(new), bool)
            for i, k in enumerate(new.tolist()):
                a, b = pieces[k >> 32], pieces[k & 0xFFFFFFFF]
                known = memo.get(a)
                ok = known.get(b) if known is not None else None
                got[i] = fit(a, b) if ok is None else ok
            out[miss] = got[back]
            self.keys[slot[miss]] = key[miss]
            self.vals[slot[miss]] = got[back]
            # two keys of one slot: the last write wins for both arrays only if made in the same order
            clash = self.keys[slot[miss]] != key[miss]
            if clash.any():
                self.keys[slot[miss[clash]]] = -1
        return out

    def encode(self, segs: list[str]) -> list[bytes]:
        size = np.array([len(s) for s in segs], np.int64)
        n, wide = len(segs), int(size.max())
        code = self.code[np.frombuffer("".join(segs).encode("utf-32-le"), np.uint32)]
        begin = np.cumsum(size) - size
        grid = np.zeros((wide, n), np.uint8)
        row = np.repeat(np.arange(n), size)
        grid[np.arange(len(code)) - np.repeat(begin, size), row] = code
        longest = np.empty((wide, n), np.int32)
        state = np.zeros(n, np.int32)
        for p in range(wide - 1, -1, -1):
            state = self.goto[state, grid[p]]
            longest[p] = self.best[state]
        stack = np.zeros((wide + 1, n), np.int32)
        top = np.zeros(n, np.int64)
        pos = np.zeros(n, np.int64)
        failed = np.zeros(n, np.uint64)
        cand = longest[0].copy()
        live = np.arange(n)
        one = np.uint64(1)
        while len(live):
            c, p, t = cand[live], pos[live], top[live]
            end = p + self.size[c]
            ok = (failed[live] >> end.astype(np.uint64) & one) == 0
            test = np.flatnonzero(ok & (t > 0))
            if len(test):
                ok[test] = self.fits(stack[t[test] - 1, live[test]], c[test])
            g = live[ok]
            if len(g):
                stack[t[ok], g] = c[ok]
                top[g] += 1
                pos[g] = end[ok]
                more = end[ok] < size[g]
                cand[g[more]] = longest[pos[g[more]], g[more]]
            b = ~ok
            if b.any():
                shorter = self.shorter[c[b]]
                w = live[b]
                cand[w] = shorter
                dead = w[shorter < 0]
                if len(dead):
                    failed[dead] |= one << pos[dead].astype(np.uint64)
                    top[dead] -= 1
                    back = stack[top[dead], dead]
                    pos[dead] -= self.size[back]
                    cand[dead] = back
            live = live[pos[live] < size[live]]
        order = np.repeat(np.arange(n), top)
        flat = stack[np.arange(len(order)) - np.repeat(np.cumsum(top) - top, top), order].astype(self.model.dtype).tobytes()
        w = self.model.dtype.itemsize
        cuts = (np.concatenate([[0], np.cumsum(top)]) * w).tolist()
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]


_MODELS: dict[bytes, MergeModel] = {}
KEPT["bpe"] = _MODELS.clear


def model_of(blob: bytes) -> MergeModel:
    """One model per Python worker."""
    key = hashlib.sha256(blob).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = MergeModel(blob)
    return _MODELS[key]
