"""Katz backoff: Good-Turing discounted n-gram counts, exactly normalised backoff weights, evaluated recursively for each token.

The model never is in one place. Counts live in buckets of words and of bigrams, partitions of the cluster's tables. Texts are staged in
chunks (see staged.py); a chunk asks the buckets for what its own tokens need and evaluates them:
1. By word: a chunk sends its distinct words with their counts in training texts and is told their counts in all and their names: numbers, low
   ones for frequent words, by which words are called from then on.
2. By history: it sends its distinct bigrams with training counts and the words' counts, and is told the bigrams' counts in all and, for each
   history, what its backoff weight needs: how many successors were seen once to LIMIT times, and what the sum of their unigram probabilities follows from: how
   many of them have which of the discounted counts, and the sum of the others' counts.
   Where all successors of a history are the chunk's own, it adds them up itself and is told no more than that. Bigrams of very frequent
   histories are dealt by both words, and their histories' sums are added up apart.
3. It evaluates P(w|h) = d(c) c(h,w) / c(h) where the bigram was seen, else weight(h) P(w), and P(w) = d(c) c(w) / N, else the unseen mass.
4. For each higher order, the n-grams seen before are histories, under names their buckets gave them, and step 2 is taken again with the counts of the order below in place of the
   words', and those of its histories: P(w|h) = d(c) c(h,w) / c(h), else weight(h) P(w|h'), h' being h without its first word.

What a chunk is told about one order it keeps in a file beside its own, so that each answer is exchanged once."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staged as S
from . import words as W
from .common import arrow_schema, batch, bounded_batches, discard, pick, scratch, settle, written

#: Counts up to LIMIT are discounted.
LIMIT = 5
#: Hashes of the end of a text, a token, and of its beginning, a history only.
END, BEGIN = np.uint64(1), np.uint64(2)
_C = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0) to d(LIMIT), and d of more, from the numbers of types n[r] seen r times, r up to LIMIT + 1. Where the counts of counts admit no
    discount between 0 and 1 for some r, that r has none."""
    d = np.ones(LIMIT + 2)
    if n[1] > 0:
        beyond = (LIMIT + 1) * n[LIMIT + 1] / n[1]
        for r in range(1, LIMIT + 1):
            if n[r] > 0 and beyond < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond)
                if 0 < x <= 1:
                    d[r] = x
    return d


class Unigrams:
    """P(w) from counts: discounted, what is taken off going to the unseen words as one class; at least 1/(N + 1) goes there."""

    def __init__(self, tokens: int, types: int, n: np.ndarray) -> None:
        self.tokens, self.types, self.d = int(tokens), int(types), discounts(n)
        taken = sum(r * n[r] * (1 - self.d[r]) for r in range(1, LIMIT + 1)) / max(1, self.tokens)
        self.unseen = max(taken, 1 / (self.tokens + 1))
        self.scale = (1 - self.unseen) / max(1e-300, 1 - taken)

    def p(self, counts: np.ndarray) -> np.ndarray:
        seen = self.d[np.minimum(counts, LIMIT + 1)] * counts / max(1, self.tokens) * self.scale
        return np.where(counts > 0, seen, self.unseen)


def weights(c: np.ndarray, off: np.ndarray, unigram_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight and scale of histories seen c times, of whose successors' counts `off` were taken off. Where nothing was, 1/(c + 1) is,
    by scaling the seen successors down."""
    taken = off / np.maximum(c, 1)
    none = taken <= 1e-12
    scale = np.where(none, c / (c + 1), 1.0)
    left = np.where(none, 1 / (c + 1), taken)
    return left / np.maximum(1e-300, 1 - unigram_sum), scale


class Tokens:
    """The tokens of a chunk as numbers of its distinct words, which are in the order of their hashes, and of their names once these are told."""

    def __init__(self, ids: list[int | None], distinct: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.numbers = ids, numbers
        # the end and the beginning take the first two numbers: no word's hash is less
        self.words = np.concatenate([[END, BEGIN], distinct])
        self.begin = 1
        self.counts = counts + 1
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), self.counts)
        self.next = np.insert(numbers.astype(np.int32) + np.int32(2), np.cumsum(counts), 0)
        self.history = np.empty_like(self.next)
        self.history[1:] = self.next[:-1]
        self.history[np.cumsum(self.counts) - self.counts] = self.begin
        self.training = ~np.array([held_out(i) for i in ids], bool)
        learnt = self.training[self.doc]
        self.learnt = learnt
        self.own = np.bincount(self.next[learnt], minlength=len(self.words))
        self.own[self.begin] = int(self.training.sum())

    @classmethod
    def of(cls, chunk: S.Chunk) -> Tokens:
        W.hasher.alone()
        return cls(chunk.ids, *W.hasher.numbered([t.decode("utf-8", "surrogatepass") for t in chunk.texts]))

    def dump(self) -> bytes:
        """For later steps, which need no texts: words are numbered anew by how often they occur, so that most numbers have few bytes."""
        n = len(self.words) - 2
        order = np.argsort(-np.bincount(self.numbers, minlength=n), kind="stable").astype(np.uint32)
        rank = np.empty(n, np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)
        return S.joined(S.squeezed(pickle.dumps(self.ids, protocol=5)), S.deltas(self.words[2:]), S.planes(order), S.planes(rank[self.numbers]), S.planes(self.counts - 1))

    @classmethod
    def load(cls, raw: bytes) -> Tokens:
        ids, distinct, order, ranks, counts = S.parts(raw)
        numbers = S.unplanes(order, np.uint32)[S.unplanes(ranks, np.uint32)].astype(np.int32)
        return cls(pickle.loads(S.spread(ids)), S.undeltas(distinct), numbers, S.unplanes(counts, np.int64))

    def asked(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        cuts = np.searchsorted(_bucket(self.words, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            yield b, S.joined(S.deltas(self.words[part]), S.planes(self.own[part].astype(np.uint32)))

    def told(self, answers: dict[int, bytes], buckets: int) -> None:
        cuts = np.searchsorted(_bucket(self.words, buckets), np.arange(buckets + 1))
        c, names = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        del self.numbers  # from now on words go by names
        for b, blob in answers.items():
            part = slice(cuts[b], cuts[b + 1])
            counts, places = S.parts(blob)
            c[part], names[part] = S.unslim(counts), S.unslim(places) * buckets + b
        order = np.argsort(names)
        self.c, self.names = c[order], names[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.next, self.history = place[self.next], place[self.history]

    def levels(self, answers: list[dict[int, bytes]], buckets: int, hot: int, unigrams: Unigrams, models: list[tuple[np.ndarray, dict]], order: int) -> tuple[Level, np.ndarray]:
        """The n-grams of the given order, and each token's probability by the order below it. answers and models (discounts, hot histories'
        sums) are those of each order from 2 on; the given one's are not needed."""
        p = unigrams.p(self.c)[self.next]
        factor = np.full(len(self.names), unigrams.scale / max(1, unigrams.tokens))
        level = Level(self.names, self.c, self.history, self, self.c[self.next], unigrams.d, factor, buckets, hot)
        for o in range(2, order):
            seen, p = level.scored(answers[o - 2], p, *models[o - 2])
            names, counts, history, factor = level.followed(seen)
            del level  # before the next is made
            level = Level(names, counts, history, self, seen, models[o - 2][0], factor, buckets, hot)
        return level, p

    def scores(self, answers: list[dict[int, bytes]], buckets: int, hot: int, unigrams: Unigrams, models: list[tuple[np.ndarray, dict]], order: int) -> np.ndarray:
        """Each token's probability by the given order, of which nothing else is kept."""
        level, p = self.levels(answers, buckets, hot, unigrams, models, order)
        return level.scored(answers[order - 2], p, *models[order - 2], last=True)[1]

    def summed(self, p: np.ndarray, unigrams: Unigrams) -> list[np.ndarray]:
        """By document: the scores by the tokens' probabilities, those of the base model, and the number of known tokens."""
        cw, docs = self.c[self.next], len(self.counts)
        base = np.log10((cw + 0.1) / (unigrams.tokens + 0.1 * (unigrams.types + 1)))
        return [np.bincount(self.doc, weights=np.log10(p), minlength=docs), np.bincount(self.doc, weights=base, minlength=docs), np.bincount(self.doc, weights=cw > 0, minlength=docs).astype(np.int64)]


class Level:
    """The n-grams of one order in a chunk: for each token the number of its history (-1: none was seen), which are in the order of their
    names. A history's backoff weight needs its successors' probabilities by the order below: `below` are the counts of the n-grams of that
    order, `below_d` its discounts, and `factor` what a history's discounted counts are multiplied by to be probabilities there."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, history: np.ndarray, tokens: Tokens, below: np.ndarray, below_d: np.ndarray, factor: np.ndarray, buckets: int, hot: int) -> None:
        """Distinct n-grams whose history and whose end were seen, by bucket, history and word; and which histories are asked about where."""
        self.below_d, self.factor = below_d, factor
        self.names, self.c, self.history, self.tokens, self.buckets = names, counts, history, tokens, buckets
        n = len(tokens.names)
        known = (history >= 0) & (below > 0)
        if len(counts):
            known &= counts[history] > 0
        at = np.flatnonzero(known).astype(np.int32)
        pair = history[at].astype(np.int64)
        pair *= n
        pair += tokens.next[at]
        bits = max(1, int(len(at)).bit_length())
        if int(n) * max(1, len(names)) < 1 << (63 - bits):  # one sort of numbers that hold the pair and its place
            pair <<= bits
            pair |= np.arange(len(at))
            pair.sort()
            order = (pair & ((1 << bits) - 1)).astype(np.int32)
            pair >>= bits
        else:
            order = np.argsort(pair, kind="stable").astype(np.int32)
            pair = pair[order]
        first = _first(pair)
        number = np.empty(len(at), np.int32)
        number[order] = np.cumsum(first, dtype=np.int32) - 1
        distinct, some = pair[first], at[order[first]]
        del pair, order, first
        h = (distinct // n).astype(np.int32)
        distinct -= h.astype(np.int64) * n
        w = distinct.astype(np.int32)
        del distinct
        own = np.bincount(number[tokens.learnt[at]], minlength=len(h)).astype(np.int32)
        spread = W.mixed(names.view(np.uint64))
        cold = _bucket(spread, buckets)
        is_hot = counts > hot
        bucket = cold[h].astype(np.min_scalar_type(buckets))  # small numbers, which numpy sorts by radix
        of_hot = np.flatnonzero(is_hot[h])
        bucket[of_hot] = _bucket(W.mixed(spread[h[of_hot]] + tokens.names[w[of_hot]].view(np.uint64) * _C), buckets)
        by_bucket = np.argsort(bucket, kind="stable").astype(np.int32)
        place = np.empty(len(h), np.int32)
        place[by_bucket] = np.arange(len(h), dtype=np.int32)
        self.at, self.pair_of = at, place[number]
        del number, place
        self.h, self.w, self.pair_own, self.pair_bucket, self.is_hot = h[by_bucket], w[by_bucket], own[by_bucket], bucket[by_bucket], is_hot
        self.some = some = some[by_bucket]
        self.below = below[some]
        # cold histories in each bucket, those without a known successor here too
        asked = np.zeros(len(names), bool)
        asked[history[history >= 0]] = True
        asks = np.flatnonzero(asked & (counts > 0) & ~is_hot)
        asks = asks[np.argsort(cold[asks], kind="stable")]
        self.asks, self.asks_bucket = asks, cold[asks]
        # a training text's n-grams were all seen: the last order's backoff weights are for other texts
        self.backs_off = np.zeros(len(names), bool)
        self.backs_off[history[(history >= 0) & ~tokens.learnt]] = True

    def sections(self) -> Iterator[tuple[int, slice, slice]]:
        pairs = np.searchsorted(self.pair_bucket, np.arange(self.buckets + 1))
        asks = np.searchsorted(self.asks_bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(pairs) + np.diff(asks)).tolist():
            yield b, slice(pairs[b], pairs[b + 1]), slice(asks[b], asks[b + 1])

    def sent(self, last: bool = False) -> Iterator[tuple[int, bytes]]:
        for b, pairs, asks in self.sections():
            h, w = self.h[pairs], self.w[pairs]
            heads = np.sort(np.concatenate([h, self.asks[asks]]), kind="stable")
            heads = heads[_first(heads)]
            place = np.searchsorted(heads, h)
            runs = np.bincount(place, minlength=len(heads))
            yield b, S.joined(S.slim(np.diff(self.names[heads], prepend=0)), S.slim(runs), _bits(self.is_hot[heads]), S.slim(self.tokens.names[w]), S.slim(self.pair_own[pairs]), S.slim(self.below[pairs]), _bits(self.backs_off[heads] | (not last)))

    def _sums(self, low: np.ndarray, high: np.ndarray, histories: np.ndarray | int) -> np.ndarray:
        """The sums of successors' probabilities by the order below, from how many have counts 1 to LIMIT there and the sum of higher counts."""
        return (high + low @ (self.below_d[1 : LIMIT + 1] * np.arange(1, LIMIT + 1))) * self.factor[histories]

    def scored(self, answers: dict[int, bytes], lower: np.ndarray, d: np.ndarray, hot: dict[int, tuple[float, ...]], last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each token's n-gram count in all training texts, and its probability, where `lower` is that by the order below."""
        n = len(self.names)
        seen = np.zeros(len(self.history), np.int64)
        if not n:
            return seen, lower
        cut = np.arange(1, LIMIT + 1) * (1 - d[1 : LIMIT + 1])
        off, sums = np.zeros(n), np.zeros(n)
        counts, own = np.zeros(len(self.h), np.int64), np.zeros(n, bool)
        self.pair_names = np.zeros(len(self.h), np.int64)
        for b, pairs, asks in self.sections():
            if b in answers:
                r, a, o, s, places, marks = S.parts(answers[b])
                counts[pairs] = S.unslim(r)
                asked = self.asks[asks]
                all_here = _unbits(a, len(asked))
                own[asked] = all_here
                asked = asked[~all_here]
                weighed = self.backs_off[asked] | (not last)
                off[asked[~weighed]] = (S.unplanes(marks, np.uint8)[:, None] >> np.arange(LIMIT) & 1) @ cut
                asked = asked[weighed]
                found = S.unslim(o).reshape(2 * LIMIT, -1).T
                off[asked] = found[:, :LIMIT] @ cut
                sums[asked] = self._sums(found[:, LIMIT:], S.unslim(s), asked)
                if places:
                    self.pair_names[pairs][counts[pairs] > 0] = np.cumsum(S.unslim(places)) * self.buckets + b
        here = np.flatnonzero(own[self.h] & (counts > 0)).astype(np.int32)
        sums += np.bincount(self.h[here], weights=lower[self.some[here]], minlength=n)
        for r in range(1, LIMIT + 1):
            off += np.bincount(self.h[here[counts[here] == r]], minlength=n) * cut[r - 1]
        del here
        for i in np.flatnonzero(self.is_hot).tolist():
            got = hot.get(int(self.names[i]))
            if got is not None:
                off[i], sums[i] = np.array(got[:LIMIT]) @ cut, self._sums(np.array(got[LIMIT : 2 * LIMIT]), got[2 * LIMIT], i)
        self.counts = counts
        weight, scale = weights(self.c, off, sums)
        del off, sums
        self.none = scale < 1
        seen[self.at] = counts[self.pair_of]
        p = np.empty(len(seen))
        for at in range(0, len(seen), BLOCK):
            part = slice(at, at + BLOCK)
            history, r, below = self.history[part], seen[part], lower[part]
            ch = np.where(history >= 0, self.c[history], 0)
            direct = d[np.minimum(r, LIMIT + 1)] * r / np.maximum(ch, 1) * scale[history]
            p[part] = np.where(ch == 0, below, np.where(r > 0, direct, weight[history] * below))
        return seen, p

    def followed(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams as histories of the next order: names, counts, by token which one goes before it in its text, and their factors."""
        before = np.full(len(self.history), -1, np.int32)
        before[self.at] = np.where(seen[self.at] > 0, self.pair_of, -1)
        history = np.full(len(before), -1, np.int32)
        history[1:] = before[:-1]
        history[np.cumsum(self.tokens.counts) - self.tokens.counts] = -1
        met = np.zeros(len(self.h), bool)
        met[history[history >= 0]] = True
        used = np.flatnonzero(met)
        if not len(used):
            return used, used, history, np.zeros(0)
        used = used[np.argsort(self.pair_names[used])]
        place = np.zeros(len(self.h), np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        at = np.flatnonzero(history >= 0).astype(np.int32)
        history[at] = place[history[at]]
        token = np.empty(len(used), np.int32)
        token[history[at]] = at
        first = self.history[token]  # of an n-gram that was seen, so these were as well
        c = self.c[first]
        return self.pair_names[used], self.counts[used], history, np.where(self.none[first], c / (c + 1), 1.0) / np.maximum(c, 1)


#: Tokens that are scored at once.
BLOCK = 1 << 16


def _first(ascending: np.ndarray) -> np.ndarray:
    """Where each distinct value is first."""
    return np.concatenate([[True], ascending[1:] != ascending[:-1]]) if len(ascending) else np.zeros(0, bool)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _types_seen(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, LIMIT + 2), minlength=LIMIT + 3)[: LIMIT + 2]


def _words_bucket(chunks: list[int], blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """By chunk, the counts of its words in all training texts and their places by descending count; for chunk -1 the numbers of tokens, types and types seen r times."""
    keys, own = zip(*((S.undeltas(k), S.unplanes(o, np.uint32)) for k, o in map(S.parts, blobs)), strict=True)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate(own), minlength=len(distinct)).astype(np.int64)
    tokens = counts[distinct != BEGIN]
    out = [(-1, S.planes(np.concatenate([[tokens.sum(), (tokens > 0).sum()], _types_seen(tokens)]).astype(np.int64)))]
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(distinct))
    ends = np.cumsum([len(k) for k in keys]).tolist()
    return out + [(c, S.joined(S.slim(counts[place[e - len(k) : e]]), S.slim(rank[place[e - len(k) : e]]))) for c, k, e in zip(chunks, keys, ends, strict=True)]


def _bits(x: np.ndarray) -> bytes:
    return S.squeezed(np.packbits(x).tobytes())


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(S.spread(raw), np.uint8), count=n).astype(bool)


def _ngrams_bucket(chunks: list[int], blobs: list[bytes], last: bool) -> list[tuple[int, bytes]]:
    """last: no higher order follows.

    By chunk, its n-grams' counts, which cold histories have no successors but the chunk's own, of the others how many successors were seen 1 to
    LIMIT times, how many are so in the order below and the sum of the higher counts there, and the places of the n-grams that were seen, for
    their names (where a higher order follows). Of histories whose weight the chunk does not need it is told which counts up to LIMIT some
    successor has. For chunk -1 the types seen r times, for chunk -2 hot histories' numbers."""
    heads, runs, hot, words, own, cw, weighed = [], [], [], [], [], [], []
    for blob in blobs:
        a, b, c, x, y, z, u = S.parts(blob)
        heads.append(np.cumsum(S.unslim(a)))
        runs.append(S.unslim(b))
        hot.append(_unbits(c, len(heads[-1])))
        words.append(S.narrow(x))
        own.append(S.narrow(y))
        cw.append(S.narrow(z))
        weighed.append(_unbits(u, len(heads[-1])))
    sizes = list(map(len, heads))
    histories, head_of = np.unique(np.concatenate(heads), return_inverse=True)
    head_of = head_of.astype(np.int32)
    del heads
    hot_history = np.zeros(len(histories), bool)
    hot_history[head_of] = np.concatenate(hot)
    own, cw, w = np.concatenate(own), np.concatenate(cw), np.concatenate(words)
    del words
    if len(histories) * (int(w.max(initial=0)) + 1) >= 1 << 63:
        w = np.unique(w, return_inverse=True)[1]
    across = int(w.max(initial=0)) + 1
    pair = np.repeat(head_of, np.concatenate(runs)).astype(np.int64)
    pair *= across
    pair += w.astype(np.int64)
    del w
    # each pair's place among the distinct ones, the first row of each, and its count
    order = np.argsort(pair, kind="stable").astype(np.int32)
    pair = pair[order]
    new = _first(pair)
    distinct_h, first = (pair[new] // across).astype(np.int32), order[new]
    del pair
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    del order, new
    counts = np.bincount(place, weights=own, minlength=len(first)).astype(np.int64)
    del own
    # a type that was seen was seen in the order below as well
    known = counts > 0
    type_h, type_r, type_c = distinct_h[known], counts[known], cw[first[known]].astype(np.int64)
    del distinct_h, first, known, cw
    numbers = np.stack([np.bincount(type_h[x == r], minlength=len(histories)) for x in (type_r, type_c) for r in range(1, LIMIT + 1)])
    types = np.bincount(type_h, minlength=len(histories))
    high = np.bincount(type_h, weights=np.where(type_c > LIMIT, type_c, 0), minlength=len(histories)).astype(np.int64)
    del type_h, type_r, type_c
    out = [(-1, S.planes(_types_seen(counts).astype(np.int64)))]
    if hot_history.any():
        out.append((-2, S.joined(S.planes(histories[hot_history]), S.planes(numbers[:, hot_history].astype(np.int64).reshape(-1)), S.planes(high[hot_history]))))
    marks = ((numbers[:LIMIT] > 0) << np.arange(LIMIT)[:, None]).sum(axis=0).astype(np.uint8)
    at_head, at_pair = 0, 0
    for c, k, r, f, u in zip(chunks, sizes, runs, hot, weighed, strict=True):
        n = int(r.sum())
        its = place[at_pair : at_pair + n]
        seen = counts[its] > 0
        its_heads = head_of[at_head : at_head + k]
        all_here = np.bincount(np.repeat(np.arange(k), r)[seen], minlength=k) == types[its_heads]
        others, rest = its_heads[~f & ~all_here & u], its_heads[~f & ~all_here & ~u]
        places = b"" if last else S.slim(np.diff(its[seen], prepend=np.int32(0)))
        out.append((c, S.joined(S.slim(counts[its]), _bits(all_here[~f]), S.slim(numbers[:, others].reshape(-1)), S.slim(high[others]), places, S.planes(marks[rest]))))
        at_head, at_pair = at_head + k, at_pair + n
    return out


BLOBS = "chunk long, bucket int, path string, blob binary"
CHUNKS = "chunk long, path string"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows, one at a time: a row's blobs are copied when it is its turn."""
    for i in range(b.num_rows):
        yield tuple(c[i].as_py() for c in b.columns)


def _by_bucket(blobs: DataFrame, answer) -> DataFrame:
    schema = arrow_schema(BLOBS)

    def group(table: pa.Table) -> pa.Table:
        found = answer(table["chunk"].to_pylist(), table["blob"].to_pylist())
        return pa.Table.from_batches([batch([[c for c, _ in found], [table["bucket"][0].as_py()] * len(found), [None] * len(found), [b for _, b in found]], schema)])

    return blobs.groupBy("bucket").applyInArrow(group, BLOBS)


def _summed(answers: DataFrame, width: int) -> np.ndarray:
    """Sums of the arrays of `width` numbers that buckets left for chunk -1: a row a bucket, added up by Spark."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in S.unplanes(blob, np.int64)], names=[f"n{i}" for i in range(width)])

    rows = answers.where("chunk = -1").select("blob").mapInArrow(opened, ", ".join(f"n{i} long" for i in range(width)))
    found = rows.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(width)]).first()
    return np.array([int(x) for x in found], np.int64)


def _hot_sums(answers: DataFrame) -> dict[int, tuple[float, ...]]:
    """The numbers of hot histories, by their names. A history is hot above a share of all tokens, so there are at most HOT_SHARE times the buckets."""
    columns = [f"n{r}" for r in range(2 * LIMIT)]
    ddl = "h long, " + ", ".join(f"{c} double" for c in [*columns, "s"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                h, numbers, high = (S.unplanes(x, np.int64) for x in S.parts(blob))
                numbers = numbers.reshape(2 * LIMIT, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, *numbers.astype(float), high.astype(float))], names=["h", *columns, "s"])

    rows = answers.where("chunk = -2").select("blob").mapInArrow(opened, ddl)
    found = rows.groupBy("h").agg(*[F.sum(c).alias(c) for c in [*columns, "s"]]).collect()
    return {r["h"]: tuple(r[c] for c in [*columns, "s"]) for r in found}


#: A history is hot if it has more than 1 / (HOT_SHARE * buckets) of all training tokens.
HOT_SHARE = 4


def katz_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, log10 of the probabilities.

    A null or empty text is its end alone. A null doc_id counts as the text "" in the split, so it is held out. Repeated rows count each. With no
    training text at all every token has the unseen class's probability, 1. An empty table gives none. All between the steps is written to
    the shared folder. `order`, 2 or more, is the number of words of the longest n-grams; each order takes another exchange."""
    if order < 2:
        raise ValueError("the order has to be 2 or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, doc_id="long", text="string")
    buckets, most = S.buckets_for(rows), 2 * S.chunk_bytes(rows)
    folder = scratch(spark, "katz")
    schema = arrow_schema(BLOBS)

    def emitted(number: int, found: list[tuple[int, bytes]], path: str | None = None) -> pa.RecordBatch:
        n = len(found) + (path is not None)
        head = [(-1, None)] if path is not None else []
        return batch([[number] * n, [b for b, _ in head + found], [path] * len(head) + [None] * len(found), [x for _, x in head + found]], schema)

    def staged(number: int, chunk: S.Chunk) -> pa.RecordBatch:
        found = Tokens.of(chunk)
        path = S.put(f"{folder}/chunks", f"{number:016x}", found.dump())
        return emitted(number, list(found.asked(buckets)), path)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in S.chunks(batches, most):
            yield staged(number, chunk)

    first = written(rows.mapInArrow(stage, BLOBS), f"{folder}/words")
    manifest = written(first.where("bucket = -1").select("chunk", "path"), f"{folder}/manifest")
    told = written(_by_bucket(first.where("bucket >= 0"), _words_bucket), f"{folder}/counts")
    discard(f"{folder}/words")
    settle(spark)
    totals = _summed(told, LIMIT + 4)
    unigrams = Unigrams(totals[0], totals[1], totals[2:])
    hot = max(1, int(totals[0]) // (HOT_SHARE * buckets))

    def kept(number: int, now: int) -> str:
        return f"{number:016x}-{now}"

    def receive(now: int):
        """The answers about order `now`, by chunk, into a file beside the chunk's."""

        def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, _, answers in _rows(b):
                    found = sorted((a["bucket"], a["blob"]) for a in answers or ())
                    S.put(f"{folder}/chunks", kept(number, now), pickle.dumps(found, protocol=5))
                yield b.select(["chunk", "path"])

        return files

    def loaded(number: int, path: str, orders: int) -> tuple[Tokens, list[dict[int, bytes]]]:
        """A chunk that was told its words, and the kept answers about orders 2 to `orders`."""
        found = Tokens.load(S.get(path))
        answers = [dict(pickle.loads(S.get(f"{folder}/chunks/{kept(number, now)}"))) for now in range(1, orders + 1)]
        found.told(answers[0], buckets)
        return found, answers[1:]

    def sender(now: int, models: list):
        # what a chunk needs is in the frame of a call, so that no two are held at once
        def one(number: int, path: str) -> pa.RecordBatch:
            found, answers = loaded(number, path, now - 1)
            level, _ = found.levels(answers, buckets, hot, unigrams, [(d, sums.value) for d, sums in models], now)
            return emitted(number, list(level.sent(now == order)))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, path in _rows(b):
                    yield one(number, path)

        return send

    last = told
    models: list = []
    for now in range(2, order + 1):
        # Answers leave the tables for the chunks' files before the next exchange, which so finds no copies of them on disk
        manifest = written(S.answered(manifest, last.where("chunk >= 0")).mapInArrow(receive(now - 1), CHUNKS), f"{folder}/manifest{now}")
        discard(f"{folder}/counts" if now == 2 else f"{folder}/order{now - 1}")
        chunks = max(1, manifest.count())
        settle(spark)  # after another query: until then something may refer to the last one
        sent = manifest.repartition(chunks, "chunk").mapInArrow(sender(now, list(models)), BLOBS)
        last = written(_by_bucket(sent, lambda chunks, blobs, last=now == order: _ngrams_bucket(chunks, blobs, last)), f"{folder}/order{now}")
        del sent
        settle(spark)
        models.append((discounts(_summed(last, LIMIT + 2)), spark.sparkContext.broadcast(_hot_sums(last))))
        settle(spark)  # again, as above
    out_schema = arrow_schema(SCORES)

    def one(number: int, path: str, answers: list | None) -> pa.RecordBatch:
        found, before = loaded(number, path, order - 1)
        own = {a["bucket"]: a["blob"] for a in answers or ()}
        p = found.scores([*before, own], buckets, hot, unigrams, [(d, sums.value) for d, sums in models], order)
        score, base, known = found.summed(p, unigrams)
        return batch([found.ids, ~found.training, found.counts, known, np.full(len(known), unigrams.tokens), base, score], out_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, path, answers in _rows(b):
                yield one(number, path, answers)

    return S.answered(manifest, last.where("chunk >= 0")).mapInArrow(finish, SCORES)
