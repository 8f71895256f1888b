"""N-best segmentation into the pieces of a published vocabulary, and back.

The pieces of a SentencePiece model that match inside a text form a lattice. A forward Viterbi
pass gives the best score of every position; these scores are exact heuristics for a backward A*
search from the end of the text, which therefore yields the best segmentation first, then the
second best, and so on. Where no piece of the vocabulary spans two neighbouring characters every
segmentation has a boundary, so the lattice of a text is a chain of small lattices: the
best segmentation of each is remembered with what its second best loses. The n best of a text
swap alternatives into the n - 1 parts that lose least; only those are searched backwards.

The vocabulary ranks its pieces by merge order; piece probabilities follow Zipf's law on that
rank. A character outside the vocabulary falls back to its UTF-8 bytes. The vocabulary itself is
read from the installed public files and never trained.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from array import array
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import public_tokenizers
import sentencepiece

MODEL = "piece_bpe_32k.model"
#: The vocabulary's sign for a space.
SPACE = "▁"
#: Runs of one kind of character with the space before them, where kinds never share a piece; else
#: whole words. ``odd`` lists numbers that are no decimal digits, such as superscripts.
KINDS = r" ?(?:[^\W\d_{odd}]+|\d|(?:[^\w ]|[_{odd}])+)| "
WORDS = re.compile(r" ?[^ ]+| ")
#: Score of a byte, below that of any piece.
BYTE_SCORE = -20.0
#: Parts remembered in each of two generations, and the longest part that is.
REMEMBERED, LONGEST = 250_000, 64

#: Factor of the rolling key of a run of characters.
STEP = np.uint64(0x100000001B3 * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF | 1)

#: Leading bits of a key that are looked up before the key itself is.
KEY_BITS = 17
SKIP_BITS = np.uint64(64 - KEY_BITS)

Part = tuple[bytes, float, float]  # best ids, best score, loss of the second best


def _kind(c: str) -> str:
    return "letter" if c.isalpha() else c if c.isdecimal() or c == " " else "other"


class PieceLattice(dict):
    """Encoder and decoder for one model file, a memory of parts as a dictionary."""

    def __init__(self, path: str, n: int) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, size = n, model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        bytes_ = {i: int(names[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in bytes_.items()}
        self.raw = [bytes([bytes_[i]]) if i in bytes_ else names[i].replace(SPACE, " ").encode() for i in range(size)]
        usable = [i for i in range(size) if not (i in bytes_ or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or SPACE in names[i][1:])]
        rank = {i: 1 + max(0.0, -model.get_score(i)) for i in usable}
        total = math.log(sum(1 / r for r in rank.values()))
        self.known = {names[i].replace(SPACE, " "): ((i,), -math.log(rank[i]) - total) for i in usable}
        self.longest = max(map(len, self.known), default=1)
        self.tables = self._tables()
        self.joined = {p[i : i + 2] for p in self.known for i in range(len(p) - 1)}
        mixed = any(a != " " and _kind(a) != _kind(b) or a.isdecimal() and b.isdecimal() for a, b in self.joined)
        odd = "".join(sorted({re.escape(c) for p in self.known for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        self.split = (WORDS if mixed else re.compile(KINDS.replace("{odd}", odd))).findall
        self.older: dict[str, Part] = {}
        self.searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def _tables(self) -> dict[int, tuple[np.ndarray, ...]]:
        """Per piece length: sorted keys, ids, scores, and whether any key begins with some bits; equal keys are refused."""
        out = {}
        for length in {len(p) for p in self.known}:
            pieces = [p for p in self.known if len(p) == length]
            key = np.zeros(len(pieces), np.uint64)
            for code in np.array(pieces, f"<U{length}").view(np.uint32).reshape(len(pieces), length).T:
                key = key * STEP + (code.astype(np.uint64) + np.uint64(1))
            order = np.argsort(key)
            assert len(np.unique(key)) == len(key), "piece keys collide"
            begins = np.zeros(1 << KEY_BITS, bool)
            begins[key >> SKIP_BITS] = True
            out[length] = key[order], np.array([self.known[pieces[i]][0][0] for i in order], np.int32), np.array([self.known[pieces[i]][1] for i in order]), begins
        return out

    def forward(self, word: str) -> tuple[list[list], list[float], list[float], tuple[int, ...]]:
        """Viterbi: arcs into every position as (start, ids, score), its two best scores, the best ids."""
        known, longest = self.known, self.longest
        arcs: list[list] = [[]]
        best, second, back = [0.0], [-math.inf], [(0, ())]
        for end in range(1, len(word) + 1):
            own, one, two, via = [], -math.inf, -math.inf, None
            for start in range(end - longest if end > longest else 0, end):
                hit = known.get(word[start:end])
                if hit is None:
                    if start < end - 1:
                        continue
                    raw = word[start].encode("utf-8", "surrogatepass")  # no piece of its own: bytes
                    arc = (start, tuple([self.byte_ids[b] for b in raw]), BYTE_SCORE * len(raw))
                else:
                    arc = (start, hit[0], hit[1])
                own.append(arc)
                score = best[start] + arc[2]
                if score > one:
                    one, two, via = score, one, arc
                elif score > two:
                    two = score
                other = second[start] + arc[2]
                if other > two:
                    two = other
            arcs.append(own)
            best.append(one)
            second.append(two)
            back.append(via)
        ids, at = (), len(word)
        while at:
            ids, at = back[at][1] + ids, back[at][0]
        return arcs, best, second, ids

    def search(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of one lattice, best first; equal scores by their ids."""
        arcs, best, *_ = self.forward(word)
        found: list[tuple[float, tuple[int, ...]]] = []
        heap: list[tuple] = [(-best[-1], (), len(word), 0.0)]  # exact cost of the whole path, its tail, where the tail begins
        while heap and len(found) < self.n:
            _, tail, at, done = heapq.heappop(heap)
            if at == 0:
                found.append((done, tail))
                continue
            for start, ids, w in arcs[at]:
                heapq.heappush(heap, (-(best[start] + w + done), ids + tail, start, done + w))
        return found

    def alternatives(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a part; those of short parts are remembered."""
        if len(part) > LONGEST:
            return self._alternatives(part)
        if part not in self.searched:
            if len(self.searched) >= REMEMBERED // 10:
                self.searched.clear()
            self.searched[part] = self._alternatives(part)
        return self.searched[part]

    def _alternatives(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        pieces = [self.search(x) for x in self.cut(part)]
        if len(pieces) == 1:
            return pieces[0]
        best = math.fsum(p[0][0] for p in pieces)
        return [(best - loss, tuple(x for i, p in enumerate(pieces) for x in p[pick.get(i, 0)][1])) for loss, pick in self.combine(pieces)]

    def cut(self, part: str) -> list[str]:
        """The part where no piece spans two neighbours."""
        joined = self.joined
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in joined]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]

    def combine(self, parts: list[list[tuple[float, tuple[int, ...]]]]) -> list[tuple[float, dict[int, int]]]:
        """The ``n`` cheapest choices of one alternative per part: (loss, {part: alternative})."""
        seconds = np.array([p[0][0] - p[1][0] if len(p) > 1 else np.inf for p in parts])
        plans: list[tuple[float, tuple]] = [(0.0, ())]
        for i in np.argsort(seconds, kind="stable")[: self.n - 1].tolist():  # no further part can be in the n best
            options = [(parts[i][0][0] - s, k) for k, (s, _) in enumerate(parts[i])]
            plans = heapq.nsmallest(self.n, [(loss + more, (*chosen, (i, k)) if k else chosen) for loss, chosen in plans for more, k in options])
        return [(loss, dict(chosen)) for loss, chosen in plans]

    def __missing__(self, part: str) -> Part:
        value = self.older.get(part)
        if value is None:
            ids, score, loss = [], 0.0, math.inf
            for piece in self.cut(part):
                _, best, second, own = self.forward(piece)
                ids += own
                score += best[-1]
                loss = min(loss, best[-1] - second[-1])
            value = (array("i", ids).tobytes(), score, loss)
        if len(part) <= LONGEST:
            self._remember(part, value)
        return value

    def _remember(self, part: str, value: Part) -> None:
        if len(self) >= REMEMBERED:  # bounds a worker's memory, not the work
            self.older = dict(self)
            self.clear()
        self[part] = value

    def learn(self, parts: set[str]) -> None:
        """Viterbi for all new parts at once, length by length; what it leaves out is searched when asked for."""
        new = parts - self.keys()
        old = [(part, self.older[part]) for part in new & self.older.keys()]
        unknown = new - self.older.keys()
        for part, value in old:
            self._remember(part, value)
        by_length: dict[int, list[str]] = {}
        for part in unknown:
            by_length.setdefault(len(part), []).append(part)
        for length, same in by_length.items():
            if length <= LONGEST and "\0" not in "".join(same):
                for at in range(0, len(same), 20_000):
                    self._learn(length, same[at : at + 20_000])

    def _learn(self, length: int, parts: list[str]) -> None:
        n = len(parts)
        code = np.array(parts, f"<U{length}").view(np.uint32).reshape(n, length).astype(np.uint64) + np.uint64(1)
        best, second = np.zeros((length + 1, n)), np.full((length + 1, n), -np.inf)
        back, used = np.zeros((length + 1, n), np.int64), np.zeros((length + 1, n), np.int32)
        whole = np.ones(n, bool)
        key = np.zeros((length, n), np.uint64)  # of the run from each start to the current end
        for end in range(1, length + 1):
            one, two = np.full(n, -np.inf), np.full(n, -np.inf)
            for start in range(max(0, end - self.longest), end):
                key[start] = key[start] * STEP + code[:, end - 1]
                table = self.tables.get(end - start)
                if table is None:
                    continue
                keys, ids, weights, begins = table
                rows = np.flatnonzero(begins[key[start] >> SKIP_BITS])
                own = key[start][rows]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                rows, at = rows[hit], at[hit]
                if start == end - 1:
                    one_piece = np.zeros(n, bool)
                    one_piece[rows] = True
                    whole &= one_piece  # a character without a piece is spelled in bytes, one part at a time
                if not len(rows):
                    continue
                w = weights[at]
                score, other = best[start][rows] + w, second[start][rows] + w
                better = score > one[rows]
                two[rows] = np.maximum(np.where(better, one[rows], np.maximum(two[rows], score)), other)
                up = rows[better]
                one[up], back[end][up], used[end][up] = score[better], start, ids[at[better]]
            best[end], second[end] = one, two
        at, column, taken = np.full(n, length), np.arange(n), []
        while at.any():
            taken.append(np.where(at > 0, used[at, column], -1))
            at = np.where(at > 0, back[at, column], 0)
        ids = np.stack(taken[::-1], 1).astype("<i4") if taken else np.zeros((n, 0), "<i4")
        skip = (ids < 0).sum(1).tolist()
        loss = np.where(np.isfinite(second[length]), best[length] - np.where(np.isfinite(second[length]), second[length], 0), np.inf)
        for i, (part, ok, score, lost) in enumerate(zip(parts, whole.tolist(), best[length].tolist(), loss.tolist(), strict=True)):
            if ok:
                self._remember(part, (ids[i, skip[i] :].tobytes(), score, lost))

    def n_best_of(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """``n_best`` of several texts, their new parts learned together.

        What is known of their different parts is put side by side, and a text is places in it.
        """
        collecting = gc.isenabled()
        gc.disable()  # parts hold no cycles, and there are many of them
        try:
            names = [self.split(" " + t) if t else [] for t in texts]
            place: dict[str, int] = defaultdict(count().__next__)
            places = [np.fromiter(map(place.__getitem__, own), np.int64, len(own)) for own in names]
            self.learn(set(place))
            spelled, scores, losses = zip(*map(self.__getitem__, place), strict=True) if place else ((), (), ())
            size = np.array([len(x) // 4 for x in spelled], np.int64)
            pool = np.frombuffer(b"".join(spelled), "<i4")
            known = pool, np.cumsum(size) - size, size, np.array(scores), np.array(losses)
            return [self._whole(own, at, known) for own, at in zip(names, places, strict=True)]
        finally:
            if collecting:
                gc.enable()

    def n_best(self, text: str) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best segmentations of a whole text with their scores, best first.

        Fewer where there are fewer; an empty text has the one empty segmentation.
        """
        return self.n_best_of([text])[0]

    def _whole(self, names: list[str], at: np.ndarray, known: tuple[np.ndarray, ...]) -> list[tuple[float, np.ndarray]]:
        """``n_best`` of a text of parts ``names``, which stand at ``at`` in what is known."""
        if not names:
            return [(0.0, np.zeros(0, np.int32))]
        pool, start, size, scores, losses = known
        base = math.fsum(scores[at].tolist())
        sizes = size[at]
        ends = np.cumsum(sizes)
        best = pool[np.repeat(start[at] - ends + sizes, sizes) + np.arange(ends[-1])]
        if self.n == 1:
            return [(base, best)]
        loss = losses[at]
        few = np.argpartition(loss, self.n - 2)[: self.n - 1] if len(loss) >= self.n else np.arange(len(loss))
        few = np.sort(few)
        options = []
        for i in few.tolist():
            first, paths = tuple(best[ends[i] - sizes[i] : ends[i]].tolist()), self.alternatives(names[i])
            options.append([(float(scores[at[i]]), first), *(p for p in paths if p[1] != first)][: self.n])  # of equal scores the one in use leads
        out = []
        for more, pick in self.combine(options):
            if not pick:
                out.append((base - more, best))
                continue
            cut, ids = 0, []
            for j, k in sorted(pick.items()):
                i = int(few[j])
                ids += [best[cut : ends[i] - sizes[i]], np.array(options[j][k][1], np.int32)]
                cut = ends[i]
            out.append((base - more, np.concatenate([*ids, best[cut:]])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation: pieces and bytes joined, without the space put in front."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def alike(self, one: np.ndarray, other: np.ndarray) -> bool:
        """Whether two segmentations spell the same text; only where they differ are they spelled."""
        n = min(len(one), len(other))
        ahead = np.flatnonzero(one[:n] != other[:n])
        start = int(ahead[0]) if len(ahead) else n
        one, other, n = one[start:], other[start:], n - start
        behind = np.flatnonzero(one[len(one) - n :][::-1] != other[len(other) - n :][::-1])
        end = int(behind[0]) if len(behind) else n
        spelled = [b"".join(map(self.raw.__getitem__, x[: len(x) - end].tolist())) for x in (one, other)]
        return spelled[0] == spelled[1]


@lru_cache(maxsize=2)
def lattice(model: str, n: int) -> PieceLattice:
    """One per worker, from the public tokenizer files or from a path."""
    return PieceLattice(model if "/" in model else public_tokenizers.path(model), n)
