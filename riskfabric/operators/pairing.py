"""Event matching of many pairs at once, on arrays inside a task: the same rule as ``match.near_event`` and the sequence ratio."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskfabric import vocabulary as V
from riskfabric.operators.match import JACCARD, LONGEST, RATIO, _coded, sequence_ratio_at_least

WORDS = 4  # 64-bit words of a bitmap of tokens
PAIRS = 1 << 18  # pairs that are tested together
_GENERAL = frozenset(V.GENERIC_EVENT_WORDS + V.EVENT_ACTORS + V.EVENT_ACTIONS + V.EVENT_TARGETS)
_ANCHORS = [V.THREAT_TERMS, V.EVENT_ACTORS, V.EVENT_ACTIONS, V.EVENT_TARGETS, V.EVENT_ROUTES, ["strike", "attack"]]


def _specific(word: str) -> bool:
    return len(word) >= 5 and word not in _GENERAL and not re.fullmatch("[0-9]+", word)


def flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


class Events:
    """Event features of headlines, one per distinct (tokens, armed): ``number`` tells a row's feature.

    Tokens are bits of a bitmap, which bounds what two sets share; it is exact while there are no more words than bits, else what the bound lets through is counted. Anchor words are
    bits of a mask of their own list.
    """

    def __init__(self, tokens: pa.Array, armed: pa.Array):
        keys = pc.binary_join(tokens, " ").dictionary_encode()
        armed = armed.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, self.number = np.unique(keys.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + armed, return_index=True, return_inverse=True)
        tokens, armed = tokens.take(pa.array(first)), armed[first].astype(bool)
        self.texts = keys.take(pa.array(first)).to_pylist()
        encoded = tokens.flatten().dictionary_encode()
        words = encoded.dictionary.to_pylist()
        self.token = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        owner = np.repeat(np.arange(len(self.size)), self.size)
        self.exact = len(words) <= 64 * WORDS
        self.special = np.array([_specific(w) for w in words], bool)
        bit = self.token % (64 * WORDS)
        self.bits, self.marks = (np.zeros((len(self.size), WORDS), np.uint64) for _ in range(2))
        for into, held in ((self.bits, slice(None)), (self.marks, self.special[self.token] if len(words) else slice(None))):
            np.bitwise_or.at(into, (owner[held], bit[held] // 64), np.uint64(1) << (bit[held] % 64).astype(np.uint64))
        self.spare = self.size - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        masks = []
        for listed in _ANCHORS:
            place = {w: i for i, w in enumerate(dict.fromkeys(listed))}
            of = np.array([1 << place[w] if w in place else 0 for w in words], np.uint64)
            mask = np.zeros(len(self.size), np.uint64)
            np.bitwise_or.at(mask, owner, of[self.token])
            masks.append(mask)
        self.threats, self.actors, self.actions, self.targets, self.routes, blows = masks
        self.struck = armed & (blows > 0)
        self.coded = None

    def near(self, x, y) -> np.ndarray:
        """``near_event`` of pairs of features."""
        out = np.zeros(len(x), bool)
        for low in range(0, len(x), PAIRS):
            out[low:low + PAIRS] = self._near(x[low:low + PAIRS], y[low:low + PAIRS])
        return out

    def _near(self, x, y):
        common = np.zeros(len(x), np.int64)
        marked = np.zeros(len(x), bool)
        for w in range(WORDS):
            common += np.bitwise_count(self.bits[x, w] & self.bits[y, w])
            marked |= (self.marks[x, w] & self.marks[y, w]) > 0
        both = self.size[x] + self.size[y]
        met = lambda of: (of[x] & of[y]) > 0
        anchored = met(self.threats) | (self.struck[x] & self.struck[y])
        acted = met(self.actions) & met(self.targets) & (met(self.actors) | met(self.routes))
        if self.exact:
            return self._decided(common, both, marked & anchored, acted)
        common += np.minimum(self.spare[x], self.spare[y])
        able = np.flatnonzero((common >= JACCARD / (1 + JACCARD) * both - 1e-9) | (marked & anchored) | (acted & (common >= 3)))
        shared, special = self._shared(x[able], y[able])
        out = np.zeros(len(x), bool)
        out[able] = self._decided(shared, both[able], (special > 0) & anchored[able], acted[able])
        return out

    @staticmethod
    def _decided(shared, both, anchors, acted):
        union = both - shared
        alike = np.divide(shared, union, out=np.zeros(len(shared)), where=union > 0) >= JACCARD
        return alike | anchors | (acted & (shared >= 3))

    def _shared(self, x, y):
        """How many tokens, and how many specific ones, pairs of features share."""
        shared, special = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        order = np.argsort(self.size[x] * self.size[y], kind="stable")  # pairs of like size together
        low = 0
        while low < len(order):
            high = min(len(order), low + PAIRS)
            cells = self.size[x[order[low:high]]] * self.size[y[order[low:high]]]
            high = low + max(1, int(np.searchsorted(np.cumsum(cells), 16 * PAIRS, side="right")))
            at, n = order[low:high], cells[:high - low]
            low = high
            pair = np.repeat(np.arange(len(at)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = self.size[y[at]][pair]
            left, right = self.token[self.first[x[at]][pair] + k // np.maximum(wide, 1)], self.token[self.first[y[at]][pair] + k % np.maximum(wide, 1)]
            same = left == right
            shared[at] = np.bincount(pair[same], minlength=len(at))
            special[at] = np.bincount(pair[same & self.special[left]], minlength=len(at)) if len(left) else 0
        return shared, special

    def ratio(self, x, y) -> np.ndarray:
        """The sequence ratio test of pairs of features (later item, seed), each distinct pair once."""
        if self.coded is None:
            self._code()
        code, back = np.unique(x * len(self.size) + y, return_inverse=True)
        x, y = code // len(self.size), code % len(self.size)
        out = np.zeros(len(x), bool)
        for low in range(0, len(x), PAIRS):
            a, b = x[low:low + PAIRS], y[low:low + PAIRS]
            least = RATIO * (self.length[a] + self.length[b])
            able = np.flatnonzero(2 * np.minimum(self.length[a], self.length[b]) >= least)
            a, b, least = a[able], b[able], least[able] - 1e-9
            held = 2 * np.minimum(self.letters[a], self.letters[b]).sum(axis=1, dtype=np.int64) >= least
            able, a, b, least = able[held], a[held], b[held], least[held]
            short = self.short[a] & self.short[b]
            held = np.ones(len(a), bool)
            held[short] = 2 * self._subsequences(a[short], b[short]) >= least[short]
            for i in np.flatnonzero(held):
                pair = (int(a[i]), int(b[i]))
                if pair not in self.known:
                    self.known[pair] = sequence_ratio_at_least(self.texts[pair[0]], self.texts[pair[1]])
                out[low + able[i]] = self.known[pair]
        return out[back]

    def _code(self):
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.short = self.length <= LONGEST
        self.coded = _coded([t if s else "" for t, s in zip(self.texts, self.short)])
        self.letters = np.zeros((len(self.texts), 32), np.int32)  # characters fold onto 32 classes, which can only raise the bound
        for i, text in enumerate(self.texts):
            self.letters[i] = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % 32, minlength=32)
        self.places = np.zeros((len(self.texts), 129), np.uint64)
        rows = np.arange(len(self.texts))
        for i in range(LONGEST):
            self.places[rows, self.coded[:, i]] |= np.uint64(1) << np.uint64(i)
        self.places[:, 128] = 0
        self.known = {}

    def _subsequences(self, x, y):
        """Length of the longest common subsequence of the texts of pairs, a bit per character and all pairs at once."""
        out = np.zeros(len(x), np.int64)
        for low in range(0, len(x), 1 << 14):
            a, b = x[low:low + (1 << 14)], self.coded[y[low:low + (1 << 14)]]
            open_ = np.full(len(a), ~np.uint64(0))
            for j in range(int(self.length[y[low:low + (1 << 14)]].max(initial=0))):
                hit = open_ & self.places[a, b[:, j]]
                open_ = (open_ + hit) | (open_ - hit)
            out[low:low + (1 << 14)] = np.bitwise_count(~open_)
        return out


def newest_of_families(events: Events, x, y, family, seen, first, last, ratio: bool):
    """For every item and family the first matching addition of its range: arrays of items and additions.

    ``x``, ``y``: features of items and of additions, which are in the order in which they count; ``family``: a number per addition; ``seen``: (item, family) that are not looked for.
    Items walk their range step by step; families that are found are not compared again, and only what lies before the first match by words is tested by the ratio.
    """
    families = int(family.max(initial=-1)) + 1
    found_item, found_at = [], []
    block = max(1, (1 << 24) // max(1, families))  # items whose open families are held at once
    for begin in range(0, len(x), block):
        end = min(len(x), begin + block)
        open_ = np.ones((end - begin, families), bool)
        mine = (seen[0] >= begin) & (seen[0] < end)
        open_[seen[0][mine] - begin, seen[1][mine]] = False
        at, step = first[begin:end].copy(), 32
        active = np.flatnonzero(at < last[begin:end])
        while len(active):
            for low in range(0, len(active), max(1, 4 * PAIRS // step)):
                items = active[low:low + max(1, 4 * PAIRS // step)]
                n = np.minimum(last[begin + items] - at[items], step)
                i = np.repeat(items, n)
                j = np.repeat(at[items] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                at[items] += n
                keep = open_[i, family[j]]
                i, j = i[keep], j[keep]
                group = i * families + family[j]
                near = events.near(x[begin + i], y[j])
                hit, place = np.unique(group[near], return_index=True)
                best = j[near][place]
                if ratio and len(group):
                    where = np.minimum(np.searchsorted(hit, group), max(0, len(hit) - 1))
                    before = ~near & ((j < best[where]) | (hit[where] != group) if len(hit) else True)
                    i, j, group = i[before], j[before], group[before]
                    alike = events.ratio(x[begin + i], y[j])
                    sooner, place = np.unique(group[alike], return_index=True)  # before the match by words, if there is one
                    other = ~np.isin(hit, sooner)
                    hit, best = np.concatenate([sooner, hit[other]]), np.concatenate([j[alike][place], best[other]])
                open_[hit // families, hit % families] = False
                found_item.append(begin + hit // families)
                found_at.append(best)
            step = min(2 * step, 1024)
            active = active[(at[active] < last[begin + active]) & open_[active].any(axis=1)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_item]), np.concatenate([none, *found_at])


TOGETHER = 128  # items whose seeds are found together


def leaders(events: Events, feature, when, timed: int, span, ratio: bool) -> np.ndarray:
    """For every item, in order, the place of the first seed it matches, its own when it opens a cluster.

    ``when`` falls from item to item; after the first ``timed`` ones come those without a time, which are near everything. Only seeds are compared: first those of earlier batches, then, where none
    matches, items of the batch with each other.
    """
    count, seeds = len(feature), np.zeros(0, np.int64)
    out = np.arange(count)
    bound = 1 << 62 if span is None else span
    for low in range(0, count, TOGETHER):
        items = np.arange(low, min(count, low + TOGETHER))
        # seeds are newer than the item, so that those within the span are the last ones
        first = np.where(items < timed, np.searchsorted(-when[seeds[seeds < timed]], -when[items] - bound, side="left"), 0)
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        i, at = newest_of_families(events, feature[items], feature[seeds], np.zeros(len(seeds), np.int64), nothing, first, np.full(len(items), len(seeds)), ratio)
        out[items[i]] = seeds[at]
        left = np.setdiff1d(items, items[i], assume_unique=True)
        x, y = np.tril_indices(len(left), -1)  # later, earlier
        x, y = left[x], left[y]
        near = (x >= timed) | (when[y] - when[x] <= bound)
        x, y = x[near], y[near]
        alike = events.near(feature[x], feature[y])
        if ratio:
            alike[~alike] = events.ratio(feature[x[~alike]], feature[y[~alike]])
        x, y = x[alike], y[alike]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        chosen = set()
        bounds = np.searchsorted(x, left), np.searchsorted(x, left, side="right")
        for item, begin, end in zip(left.tolist(), *bounds):
            seed = next((s for s in y[begin:end].tolist() if s in chosen), item)
            out[item] = seed
            if seed == item:
                chosen.add(item)
        seeds = np.concatenate([seeds, np.array(sorted(chosen), np.int64)])
    return out
