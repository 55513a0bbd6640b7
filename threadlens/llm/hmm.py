"""A hidden Markov language model over words.

Every training text feeds the model. Its words are counted over all training texts (identified by a 64-bit hash). The
most frequent words are emission classes of their own, ``GROWTH`` times the square root of the number of distinct words and
2**14 at least; the others are spread, by their last three bytes and (if they are looked up) their count's power of two,
over half as many shared classes, in which a word has its share of the class's smoothed mass. So a word's probability is
that of its class under the hidden states times a factor that the corpus-wide counts give. What is broadcast (transitions,
emissions, the counts of the most frequent words) grows with that square root; the counts of rarer words are joined.

Baum-Welch: each partition runs the scaled forward and backward recursions over its whole texts
and sends the expected counts of the classes it met; these are summed over partitions in two levels, block by block, and give
the next parameters, until the summed log likelihood rises by no more than ``tolerance`` of itself. The first iterations run on
every ``warm``-th training text, so that few passes over all of them are left; what counts as settled is the same. Scoring runs
the scaled forward recursion over whole texts; the sum of the scales' logarithms is the exact log likelihood. Recursions are
in double precision, many texts side by side; a long text goes in windows, which carry the state over their borders exactly
(``Windows``), so memory is bounded whatever a text's length.

Defined cases: a null or empty text is the end token alone; a null id trains or not by the empty string's crc32; with
no training text every token is unknown and has probability one; repeated rows are scored one by one; columns beside
doc_id and the text don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, blocks, held, mix, text_views, tidy, word_hashes, word_spans
from threadlens.session import table
from threadlens.work import Workspace

END = 0
#: Classes of their own per square root of the number of distinct words.
GROWTH = 32
#: Classes of one block of expected counts.
PART = 2048
#: Tokens that a worker takes through the recursions at once, and the longest window of one text among them.
TOKENS, WINDOW = 500_000, 1024
#: Steps of a recursion after which it is scaled; even where every token is unknown, four of them stay far from what doubles hold.
SCALED = 4


def endings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash below 2**24 of each word's last three bytes, which spreads rarer words over the shared classes."""
    return (mix(word_hashes(data, np.maximum(s, e - 3), e)) >> np.uint64(40)).astype(np.int64)


PACKED = "part long, at binary, values binary"


def packed(parts: list[int], at: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of doubles and their places in each block, as bytes."""
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *(pa.array([x.tobytes() for x in v], pa.binary()) for v in (at, values))], names=["part", "at", "values"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, n) over a one-column frame of texts: counted in each partition, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            h, x, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
            u, first, at = np.unique(h, return_index=True, return_inverse=True)
            return u, x[first], np.bincount(at, c, len(u)).astype(np.int64)

        parts, held_words = [], 0
        for batch in batches:
            data, offsets = text_views(batch.column(0))
            for a, b in blocks(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                s, e, _ = word_spans(d, o)
                u, first, c = np.unique(word_hashes(d, s, e), return_index=True, return_counts=True)
                parts.append((u, endings(d, s[first], e[first]), c))
                held_words += len(parts[-1][0])
                if held_words > 4_000_000:
                    parts = [merged(parts)]
                    held_words = len(parts[0][0])
                    if held_words > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in parts[0]], names=["word", "ending", "n"])
                        parts, held_words = [], 0
        if parts:
            whole = merged(parts)
            for i in range(0, len(whole[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(np.int64)) for x in whole], names=["word", "ending", "n"])

    return texts.mapInArrow(tidy(run), "word long, ending long, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def summed(parts: DataFrame) -> DataFrame:
    """(part, at, values as packed doubles, a row for each of ``at``) summed per part; in two levels, so that no task meets all partitions' rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = np.frombuffer(at, np.uint16)
                v = np.frombuffer(values, np.float64).reshape(len(at), -1)
                sums.setdefault(part, np.zeros((PART if part >= 0 else 1, v.shape[1])))[at] += v
        if sums:
            met = [np.flatnonzero(v.any(1)).astype(np.uint16) for v in sums.values()]
            yield packed(list(sums), met, [v[at] for at, v in zip(met, sums.values())])

    first = parts.repartition("part", "salt").select("part", "at", "values").mapInArrow(tidy(add), PACKED)
    return first.repartition("part").mapInArrow(tidy(add), PACKED)


def side_by_side(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all sequences by time step, the longest first: (order, sequences alive per step, step offsets, tokens)."""
    lens = np.array([len(s) for s in seqs])
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    flat = np.concatenate([seqs[i] for i in order])
    alive = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]), "right")
    at = np.concatenate([[0], np.cumsum(alive)])
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = np.empty(len(flat), np.int64)
    out[at[step] + np.repeat(np.arange(len(lens)), lens)] = flat
    return order, alive, at, out


class Windows:
    """Sequences cut into windows of at most ``window`` tokens that know what comes before and after, so that no transition is cut.

    A window's transfer matrix leads from the state before it to the one at its end. A sequence's first window is only entered from
    ``start`` and nothing follows its last one, so these two need a vector each and no matrix. All are found side by
    side; a chain over the windows of a sequence then gives each window the filtered state at the end of the one before
    (``before``, states by windows; ``start`` holds for first windows) and, up to a factor, the likelihood of all that follows
    (``after``, ones unless ``both`` directions are asked for).
    """

    def __init__(self, seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, window: int, limit: int, both: bool = True):
        self.start, self.move, self.emit, self.limit = start, move, np.ascontiguousarray(emit.T), limit
        n = np.array([-(-len(s) // window) for s in seqs])
        self.of = np.repeat(np.arange(len(seqs)), n)
        self.pieces = [s[i : i + window] for s in seqs for i in range(0, len(s), window)]
        self.first = np.ones(len(self.of), bool)
        self.first[1:] = self.of[1:] != self.of[:-1]
        k = len(start)
        self.before, self.after = np.zeros((k, len(self.of))), np.ones((k, len(self.of)))
        ends = np.cumsum(n)
        cut = np.flatnonzero(n > 1)
        head = dict(zip(cut.tolist(), self._vectors([self.pieces[i] for i in ends[cut] - n[cut]], start, move.T)))
        tail = dict(zip(cut.tolist(), self._vectors([self.pieces[i][::-1] for i in ends[cut] - 1], np.ones(k), move))) if both else {}
        inner = np.flatnonzero(~self.first & (np.append(self.of[1:], -1) == self.of))
        matrix = np.zeros((len(inner), k, k))
        for group in by_length([self.pieces[i] for i in inner], limit):
            matrix[group] = self._transfer([self.pieces[inner[i]] for i in group])
        at = dict(zip(inner.tolist(), range(len(inner))))
        for s in cut.tolist():
            a, b = int(ends[s] - n[s]), int(ends[s])
            state = self.before[:, a + 1] = head[s]
            for i in range(a + 1, b - 1):
                state = (state @ move) @ matrix[at[i]]
                state = self.before[:, i + 1] = state / state.sum()
            if both:
                rest = self.after[:, b - 2] = move @ tail[s]
                for i in range(b - 2, a, -1):
                    rest = move @ (matrix[at[i]] @ rest)
                    rest = self.after[:, i - 1] = rest / rest.sum()

    def _vectors(self, pieces: list[np.ndarray], first: np.ndarray, by: np.ndarray) -> np.ndarray:
        """... diag(e_2) by diag(e_1) by diag(e_0) first for each piece (pieces by states), scaled to sum one."""
        out = np.empty((len(pieces), len(first)))
        for group in by_length(pieces, self.limit):
            order, alive, at, seen = side_by_side([pieces[i] for i in group])
            order = np.array(group)[order]
            v = first[:, None] * self.emissions(seen[: at[1]])
            for t, n in enumerate(alive[1:], 1):
                if n < v.shape[1]:
                    out[order[n : v.shape[1]]] = v[:, n:].T
                v = by @ v[:, :n]
                v *= self.emissions(seen[at[t] : at[t + 1]])
                if t % SCALED == 0:
                    v /= v.sum(0)
            out[order[: v.shape[1]]] = v.T
        return out / out.sum(1, keepdims=True)

    def _transfer(self, pieces: list[np.ndarray]) -> np.ndarray:
        """diag(e_0) (move diag(e_1)) (move diag(e_2)) ... of each piece, up to a factor."""
        order, alive, at, seen = side_by_side(pieces)
        k = len(self.start)
        out = np.empty((len(pieces), k, k))
        m = np.zeros((k, k, len(pieces)))  # state at the end, state before, piece
        e = self.emissions(seen[: at[1]])
        m[np.arange(k), np.arange(k)] = e
        for t, n in enumerate(alive[1:], 1):
            if n < m.shape[2]:
                out[order[n : m.shape[2]]] = m[:, :, n:].transpose(2, 1, 0)
                m = m[:, :, :n]
            m = (self.move.T @ m.reshape(k, -1)).reshape(k, k, n)
            m *= self.emissions(seen[at[t] : at[t + 1]])[:, None]
            if t % 8 == 0:
                m /= m.sum((0, 1))
        out[order[: m.shape[2]]] = (m / m.sum((0, 1))).transpose(2, 1, 0)
        return out

    def emissions(self, seen: np.ndarray) -> np.ndarray:
        """States by tokens; every token is a class, and so numpy need not look for others."""
        return np.take(self.emit, seen, axis=1, mode="clip")

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of like length that are taken through the recursions at once: their indices, longest first, and ``side_by_side``'s arrays."""
        for group in by_length(self.pieces, self.limit):
            order, alive, at, seen = side_by_side([self.pieces[i] for i in group])
            yield np.array(group)[order], alive, at, seen

    def entry(self, own: np.ndarray) -> np.ndarray:
        """Chances of the states of each window's first token, before that token is seen."""
        return np.where(self.first[own], self.start[:, None], self.move.T @ self.before[:, own])


def log_likelihood(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, window: int = WINDOW, limit: int = TOKENS) -> np.ndarray:
    """Natural-log likelihood of each sequence by the scaled forward recursion, in double precision."""
    w = Windows(seqs, start, move, emit, window, limit, both=False)
    total = np.zeros(len(w.pieces))
    for own, alive, at, seen in w.groups():
        a, sums = w.entry(own), np.zeros(len(own))
        for t, n in enumerate(alive):
            if t:
                sums[n : a.shape[1]] += np.log(a[:, n:].sum(0))  # windows that have ended
                a = move.T @ a[:, :n]
            a *= w.emissions(seen[at[t] : at[t + 1]])
            if t % SCALED == 0:
                s = a.sum(0)
                a /= s
                sums[:n] += np.log(s)
        sums[: a.shape[1]] += np.log(a.sum(0))
        total[own] = sums
    return np.bincount(w.of, total, len(seqs))


def expected(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, window: int = WINDOW, limit: int = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected counts over whole sequences: emissions (class, state), transitions, starts; and the log likelihood."""
    w = Windows(seqs, start, move, emit, window, limit)
    k = len(start)
    emitted, moves, starts, likelihood = np.zeros((k, len(emit))), np.zeros((k, k)), np.zeros(k), 0.0
    for own, alive, at, seen in w.groups():
        e = w.emissions(seen)
        forward = np.empty_like(e)
        for t, n in enumerate(alive):
            a = forward[:, at[t] : at[t + 1]]
            if t:
                np.matmul(move.T, forward[:, at[t - 1] : at[t - 1] + n], out=a)
            else:
                a[:] = w.entry(own)
            a *= e[:, at[t] : at[t + 1]]
            if t % SCALED == 0:
                s = a.sum(0)
                a /= s
                e[:, at[t] : at[t + 1]] /= s
                likelihood += float(np.log(s).sum())
        size = np.array([len(w.pieces[i]) for i in own])
        last = forward[:, at[size - 1] + np.arange(len(own))]
        likelihood += float(np.log(last.sum(0)).sum())
        rest = w.after[:, own] / (last * w.after[:, own]).sum(0)
        ahead = np.empty((k, 0))
        for t in range(len(alive) - 1, -1, -1):
            x, n = slice(at[t], at[t + 1]), ahead.shape[1]
            backward = rest[:, : alive[t]].copy()  # windows that end here, and in place of the others
            if n:
                np.matmul(move, ahead, out=backward[:, :n])
                moves += forward[:, at[t] : at[t] + n] @ ahead.T
            ahead = e[:, x]
            ahead *= backward
            forward[:, x] *= backward
        first = w.first[own]
        moves += w.before[:, own[~first]] @ ahead[:, ~first].T
        starts += forward[:, : at[1]][:, first].sum(1)
        for i in range(k):
            emitted[i] += np.bincount(seen, forward[i], minlength=len(emit))
    return emitted.T, moves * move, starts, likelihood


def by_length(seqs: list[np.ndarray], limit: int) -> Iterator[list[int]]:
    """Indices of sequences of like length, at most ``limit`` tokens together."""
    group, held_tokens = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: len(seqs[i])):
        if group and held_tokens + len(seqs[i]) > limit:
            yield group
            group, held_tokens = [], 0
        group.append(i)
        held_tokens += len(seqs[i])
    if group:
        yield group


class Lookup:
    """Places of hashes in a sorted array of them, as ``searchsorted`` finds them: a table of leading bits says where to begin."""

    def __init__(self, words: np.ndarray):
        self.words = words
        bits = min(24, 2 + len(words).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.zeros(1 << bits, np.int32)
        np.cumsum(np.bincount((words >> self.shift).astype(np.int64), minlength=1 << bits)[:-1], out=self.begin[1:])

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether the hash is there); a place is only right where it is."""
        if not len(self.words):
            return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        at, end = self.begin[h >> self.shift], len(self.words) - 1
        np.minimum(at, end, out=at)
        met = self.words[at]
        found, behind = met == h, np.flatnonzero(met < h)
        while len(behind):
            behind = behind[at[behind] < end]
            at[behind] += 1
            met = self.words[at[behind]]
            found[behind] = met == h[behind]
            behind = behind[met < h[behind]]
        return at, found


class Model:
    """Corpus statistics and parameters, of a size that grows with the square root of the vocabulary unless ``classes`` fixes it."""

    def __init__(self, counts: DataFrame, n_texts: int, states: int, classes: int | None, lookup: int, seed: int):
        bins = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
        groups = sorted(counts.groupBy(bins.alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
        self.total = sum(g["n"] for g in groups) + n_texts
        self.distinct = sum(g["words"] for g in groups) + (n_texts > 0)
        self.mass = self.total + 0.1 * (self.distinct + 1)
        if classes is None:
            classes = max(1 << 14, int(GROWTH * math.sqrt(self.distinct)))
            lookup = max(lookup, 4 * classes)
        least, taken = None, 0
        for g in groups:
            if taken + g["words"] > lookup:
                break
            least, taken = g["bin"], taken + g["words"]
        self.words, self.n, self.cls = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        own, ending = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if least is not None:
            top = counts.where(bins >= least).toArrow()
            words, n = top["word"].to_numpy().astype(np.uint64), top["n"].to_numpy()
            by = np.argsort(words)
            self.words, self.n, ending = words[by], n[by], top["ending"].to_numpy()[by]
            own = np.lexsort((self.words, -self.n))[: classes - 1]
        #: shared classes follow the words' own ones
        self.first, self.shared = len(own) + 1, max(1, classes // 2)
        band = 1 + np.log2(np.maximum(self.n, 1)).astype(np.int64)
        self.cls = (self.first + (ending + 7919 * band) % self.shared).astype(np.uint32)
        self.cls[own] = np.arange(1, len(own) + 1)
        p = np.bincount(self.cls, self.n + 0.1, self.first + self.shared).astype(float)
        p[END] = n_texts + 0.1 if n_texts else 0
        rest = counts if least is None else counts.where(bins < least)
        for g in rest.groupBy((F.col("ending") % self.shared).alias("at")).agg((F.sum("n") + 0.1 * F.count("*")).alias("p")).collect():
            p[self.first + g["at"]] += g["p"]
        p[self.first :] += 0.1 / self.shared  # unknown words
        size = len(p)
        self.prior, self.n_texts = p / self.mass, n_texts
        rng = np.random.default_rng(seed)
        self.emit = self.prior[:, None] * np.exp(rng.normal(0, 1, (size, states)))
        self.emit /= self.emit.sum(0)
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9)
        self.move /= self.move.sum(1, keepdims=True)
        self.start = np.full(states, 1 / states)

    def parameters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.start, self.move, self.emit

    def update(self, sums: dict[int, tuple[np.ndarray, np.ndarray]], prior_weight: float = 200.0) -> float:
        """Takes summed (places, values) per block as the next parameters; returns the log likelihood under the last ones."""
        k = len(self.start)
        emitted = np.zeros((len(self.emit), k))
        for part, v in sums.items():
            if part >= 0:
                at, values = v
                emitted[part * PART + at.astype(np.int64)] = values.reshape(-1, k)
        rest = sums[-1][1] if -1 in sums else np.zeros(k * k + k + 1)
        moves, starts, likelihood = rest[: k * k].reshape(k, k), rest[k * k : -1], rest[-1]
        self.emit = (emitted + prior_weight * self.prior[:, None]) / (emitted.sum(0) + prior_weight)
        self.move = (moves + 1) / (moves.sum(1, keepdims=True) + k)
        self.start = (starts + 1) / (starts.sum() + k)
        return float(likelihood)


def classed(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of (row, text, train): token classes, the base score over frequent words, and the rarer words' hashes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.words, model.n, model.cls, model.mass, model.n_texts, model.first, model.shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, cls, mass, n_texts, first, spread = shared.value
        end = END if n_texts else first
        logs = np.log10((n + 0.1) / mass)
        end_log = math.log10((n_texts + 0.1) / mass)
        lookup = Lookup(words)
        for batch in batches:
            data, offsets = text_views(batch.column(0))
            for a, b in blocks(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                s, e, w = word_spans(d, o)
                h = word_hashes(d, s, e)
                at, found = lookup(h)
                own = np.repeat(np.arange(len(w) - 1), np.diff(w))
                score = np.bincount(own, np.where(found, logs[at], 0) if len(words) else None, len(w) - 1) * (len(words) > 0)
                known = np.concatenate([[0], np.cumsum(found)])
                rare = h[~found].astype(np.int64)
                rare_off = (w - known[w]).astype(np.int32)
                token = cls[at] if len(words) else np.zeros(len(h), np.uint32)
                token[~found] = first + endings(d, s[~found], e[~found]) % spread
                tokens = np.insert(token, w[1:], end)
                t_off = (w + np.arange(len(w))) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(w) - 1, [None, pa.py_buffer(t_off.astype(np.int32)), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)),
                        ids,
                        pa.array(np.diff(w) + 1),
                        pa.array(np.diff(known[w]) + (n_texts > 0)),
                        pa.array(score + end_log),
                        pa.ListArray.from_arrays(pa.array(rare_off), pa.array(rare)),
                    ],
                    names=["row", "doc_id", "train", "ids", "n_tokens", "known", "base", "rare"],
                )

    return docs.select("text", "row", "doc_id", "train").mapInArrow(tidy(run), "row long, doc_id long, train boolean, ids binary, n_tokens long, known long, base double, rare array<long>")


def baum_welch(tokens: DataFrame, model: Model, window: int) -> float:
    """One iteration over the rows of ``tokens``: partitions' expected counts, summed, become the new parameters. Returns the log likelihood before it."""
    shared = tokens.sparkSession.sparkContext.broadcast(model.parameters())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = shared.value
        k = len(start)
        emitted, rest, seqs, n = np.zeros((len(emit), k)), np.zeros(k * k + k + 1), [], 0

        def flush():
            nonlocal emitted, rest
            e, m, s, ll = expected(seqs, start, move, emit, window)
            emitted += e
            rest += np.concatenate([m.ravel(), s, [ll]])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seqs.append(np.frombuffer(text, np.uint32))
                n += len(seqs[-1])
            if n > 4 * TOKENS:
                flush()
                seqs, n = [], 0
        if seqs:
            flush()
        if emitted.any():
            met = np.flatnonzero(emitted.any(1))
            parts = np.unique(met // PART)
            own = np.split(met, np.searchsorted(met, parts[1:] * PART))
            yield packed([*parts.tolist(), -1], [*((x % PART).astype(np.uint16) for x in own), np.zeros(1, np.uint16)], [*(emitted[x] for x in own), rest])

    parts = tokens.select("ids").mapInArrow(tidy(run), PACKED)
    got = summed(parts.withColumn("salt", F.spark_partition_id() % 32)).collect()
    likelihood = model.update({r["part"]: (np.frombuffer(r["at"], np.uint16), np.frombuffer(r["values"], np.float64)) for r in got})
    shared.unpersist()
    return likelihood


def settle(tokens: DataFrame, model: Model, window: int, tolerance: float) -> None:
    """Iterations until the log likelihood rises by no more than ``tolerance`` of itself."""
    last = -math.inf
    while (likelihood := baum_welch(tokens, model, window)) - last > tolerance * abs(likelihood):
        last = likelihood


def forward(tokens: DataFrame, model: Model, window: int) -> DataFrame:
    """Per row: log10 likelihood of its classes less their prior, which turns a base score into the model's."""
    shared = tokens.sparkSession.sparkContext.broadcast((*model.parameters(), np.log10(np.maximum(model.prior, 1e-300))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, prior = shared.value

        def flush(rows, seqs):
            out = log_likelihood(seqs, start, move, emit, window) / math.log(10) - [prior[s].sum() for s in seqs]
            table_ = pa.Table.from_batches(rows)
            return table_.append_column("gain", pa.array(out)).combine_chunks().to_batches()

        rows, seqs, n = [], [], 0
        for batch in batches:
            rows.append(batch.select([i for i in range(batch.num_columns) if batch.schema.names[i] != "ids"]))
            for text in batch.column("ids").to_pylist():
                seqs.append(np.frombuffer(text, np.uint32))
                n += len(seqs[-1])
            if n > 4 * TOKENS:
                yield from flush(rows, seqs)
                rows, seqs, n = [], [], 0
        if rows:
            yield from flush(rows, seqs)

    return tokens.select("row", "doc_id", "train", "n_tokens", "known", "base", "ids").mapInArrow(
        tidy(run), "row long, doc_id long, train boolean, n_tokens long, known long, base double, gain double"
    )


def score_texts(
    docs: DataFrame, train, text: str = "text", states: int = 8, iterations: int | None = None, classes: int | None = None, lookup: int = 1 << 18, window: int = WINDOW, seed: int = 7, tolerance: float = 1e-4, warm: int = 8
) -> tuple[DataFrame, Model]:
    """Train on the rows where ``train`` holds, ``iterations`` times or until it settles, and score all rows of ``docs`` (doc_id, text).

    Without ``iterations`` training begins on every ``warm``-th row until it settles there, and goes on over all rows until it settles.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    work = Workspace(spark, "hmm")
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"), "doc_id", train.alias("train"))
    counts = work.keep(word_counts(rows.where("train").select("text")), "counts")
    model = Model(counts, rows.where("train").count(), states, classes, lookup, seed)
    tokens = work.keep(classed(rows, model), "tokens")
    trained = tokens.where("train")
    if iterations is None:
        some = work.keep(trained.where(F.pmod(F.xxhash64("row"), F.lit(warm)) == 0).select("ids"), "warm")  # each of its passes reads these rows alone
        settle(some, model, window, tolerance)
        work.drop(some)
        settle(trained, model, window, tolerance)
    for _ in range(iterations or 0):
        baum_welch(trained, model, window)
    rare = tokens.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    seen = rare.groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / model.mass)).alias("rare_base"), F.count("n").alias("rare_known")
    )
    scored = forward(tokens, model, window).join(seen, "row", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain")).alias("score"),
    ), model


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; those whose id's crc32 ends in 0 (mod 10) are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, ~held("doc_id", 10, 0))[0]
