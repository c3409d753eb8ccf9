"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts of all training words are gathered by a grouped sum. The most frequent words, the end of a text and classes of
other words are the model's outputs. The ``known_words`` most frequent words all have vectors of their own, as targets and as contexts: those that
aren't outputs are members of classes of about the square root of their number. Words beyond
them are dealt by their number into groups, as many as the square root of their types; a group has vectors of its own, as a member of classes of other words, and shares
its probability out by smoothed counts, one unseen word included. The probability of a word is its class's times its share of
the class, both softmaxes, so the distribution over words is normalised. The model (Mnih and Teh 2012) predicts a vector from the two
tokens before, scores by inner product and bias, and is trained with noise words: for outputs from the unigram distribution, within a class from its members alike.
Each task runs through all its training texts, and the tasks' moves of each row are averaged by the tokens that made them, as often as there are
rounds. As scores are sums of a part for each of the two tokens, the sum over the outputs is an inner product of two rows of exponentials, which
a task makes once; classes take one matrix product each for a batch. Equal contexts of a batch are summed once.

The counts of the ``known_words`` most frequent words are broadcast (a fixed bound); all other words meet their
counts in a join on the word's number, whose groups are small as frequent words aren't in it.

Defined results: a null or empty text is its end token alone; a null id is text of the training part; repeated rows
count and are scored each; without training texts the model is uniform over end and other words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import settle
from textloom.llm.words import SPACES, batches_of_words

END, OTHER, FIRST = 0, 1, 2
CHUNK = 1 << 15


def is_held_out(id_: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % parts == part, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts; flushed when it holds ``most`` words."""
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merged(parts_w: list, parts_c: list) -> tuple[np.ndarray, np.ndarray]:
        w, inverse = np.unique(np.concatenate(parts_w), return_inverse=True)
        return w, np.bincount(inverse, np.concatenate(parts_c), len(w)).astype(np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    waiting_w, waiting_c, size = [words], [counts], 0
    for batch in batches:
        for _, _, number in batches_of_words(batch.column(0), SPACES):
            w, c = np.unique(number, return_counts=True)
            waiting_w.append(w)
            waiting_c.append(c)
            size += len(w)
            if size > most:
                words, counts = merged(waiting_w, waiting_c)
                if len(words) > most // 2:
                    yield out()
                    words, counts = words[:0], counts[:0]
                waiting_w, waiting_c, size = [words], [counts], len(words)
    words, counts = merged(waiting_w, waiting_c)
    yield out()


class Vocabulary:
    """Items: what a token is to the model. END, OTHER, the most frequent words (heads), then the members of classes.

    With ``tail``, all given words beyond the heads are members with vectors of their own, in classes of ``width`` words, and the
    words that aren't given here are dealt into groups by their number, each group a member of the class OTHER or, beyond ``width``
    groups, of one of more such classes at the end; ``tail`` has (tokens, types) of each group. Without it OTHER holds all other words as its only member."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, outputs: int, texts: int, tokens: int, types: int, tail: np.ndarray | None = None, width: int = 1):
        order = np.lexsort((words, -counts))
        words, counts = words[order], counts[order]
        top = counts[: outputs - FIRST]
        self.first_member = FIRST + len(top)
        other = tokens - texts - int(top.sum())
        #: smoothed mass of the class of other words: each of its types once more, and one unseen type
        self.other_mass = other + max(0, types - (texts > 0) - len(top)) + 1
        groups = np.array([[other, self.other_mass - 1 - other]]) if tail is None else tail
        own = counts[len(top) :] if tail is not None else counts[:0]
        classes = -(-len(own) // width)
        #: number of groups, and each group's smoothed mass with one unseen type
        self.groups, self.mass = len(groups), groups.sum(1) + 1.0
        output = np.full(len(words), self.first_member, np.int64)
        output[: len(top)] = np.arange(FIRST, self.first_member)
        output[len(top) : len(top) + len(own)] = self.first_member + self.groups + np.arange(len(own))
        order = np.argsort(words)
        self.words, self.counts, self.output = words[order], counts[order], output[order]
        #: by a word's last bits its slot, -1 where there is none, -2 where there are several
        self.slots = np.full(1 << max(4, len(words).bit_length() + 3), -1, np.int32)
        last, at, times = np.unique(self._last(self.words), return_index=True, return_counts=True)
        self.slots[last] = np.where(times > 1, -2, at)
        #: by item its output
        more = np.arange(self.groups) // max(width, 1) if tail is not None else np.zeros(self.groups, np.int64)
        kind = np.concatenate([np.where(more == 0, OTHER, self.first_member + classes + more - 1), self.first_member + np.arange(len(own)) // width])
        self.top = np.concatenate([np.arange(self.first_member), kind])
        self.size, self.texts, self.tokens, self.types = self.first_member + classes + int(more[-1]), texts, tokens, types
        #: by member the members of its class [low, high) and its share of the class
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        ends = np.append(starts[1:], len(kind))
        self.low, self.high = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        weight = np.concatenate([groups[:, 0] + 1.0, own.astype(float)])
        inner = np.bincount(kind, weight, self.size)
        self.share = weight / inner[kind]
        weight = np.concatenate([[texts + 1.0, inner[OTHER]], top.astype(float), inner[self.first_member :]])
        self.unigram = weight / weight.sum()

    def _last(self, number: np.ndarray) -> np.ndarray:
        return (number & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, count) of each word; count -1 for words that aren't known here."""
        far = self.first_member + number.view(np.int64) % self.groups
        if not len(self.words):
            return far, np.full(len(number), -1, np.int64)
        slot = self.slots.take(self._last(number))
        several = np.flatnonzero(slot == -2)
        slot[several] = np.minimum(np.searchsorted(self.words, number[several]), len(self.words) - 1)
        hit = self.words[slot] == number
        return np.where(hit, self.output[slot], far), np.where(hit, self.counts[slot], -1)


class LogBilinear:
    """score(w | a, b) = (first[a] + second[b]) . out[w] + bias[w] over the outputs; likewise over a class's members by ``inner`` and ``slope``."""

    def __init__(self, vocabulary: Vocabulary, dim: int, seed: int = 5):
        rng, v = np.random.default_rng(seed), vocabulary
        self.first, self.second, self.out, self.inner = (0.1 * rng.standard_normal((k, dim), np.float32) for k in (len(v.top), len(v.top), v.size, len(v.share)))
        self.bias, self.slope, self.vocabulary = np.log(v.unigram).astype(np.float32), np.log(v.share).astype(np.float32), v
        #: by row the sum of its gradients' mean squares
        self.squares = [np.full(len(x), 1e-8, np.float32) for x in self.parts()]
        #: tokens that have moved each row
        self.moved = [np.zeros(len(x), np.float32) for x in self.parts()]
        self.tables = np.empty((0, v.size), np.float32), np.empty((0, v.size), np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.first, self.second, self.out, self.bias, self.inner, self.slope]

    def add(self, moves: list[np.ndarray]) -> None:
        for x, y in zip(self.parts(), moves):
            x += y.reshape(x.shape)

    def _step(self, parts: tuple[int, ...], rows: np.ndarray, grads: list[np.ndarray], rate: float) -> None:
        """Adaptive step on the sum of the rows' gradients."""
        order = np.argsort(rows)
        rows = rows[order]
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows, times = rows[start], np.diff(np.append(start, len(order)))
        many = np.flatnonzero(times > 1)
        repeats = order[np.repeat(times > 1, times)]
        edges = np.concatenate([[0], np.cumsum(times[many])[:-1]]).astype(np.int64)
        for k, grad in zip(parts, grads):
            x, total = self.parts()[k], grad.take(order[start], axis=0)
            if len(many):
                total[many] = _summed(grad.take(repeats, axis=0), edges)
            own = self.squares[k].take(rows) + (total * total if total.ndim == 1 else np.einsum("ij,ij->i", total, total) / total.shape[1])
            self.squares[k][rows] = own
            pace = rate / np.sqrt(own)
            total *= pace if total.ndim == 1 else pace[:, None]
            total += x.take(rows, axis=0)
            x[rows] = total
            self.moved[k][rows] += times

    def learn(self, a: np.ndarray, b: np.ndarray, item: np.ndarray, rng: np.random.Generator, noise: int = 64, rate: float = 0.05) -> None:
        """One step on the tokens ``item`` after ``a`` and ``b``, with noise outputs that all of them share."""
        v = self.vocabulary
        t, n, r = v.top[item], rng.choice(v.size, noise, p=v.unigram), self.first.take(a, axis=0)
        r += self.second.take(b, axis=0)
        chance = np.log(noise * v.unigram).astype(np.float32)
        out_t, out_n = self.out.take(t, axis=0), self.out[n]
        g_t = 1 / (1 + np.exp(np.einsum("ij,ij->i", r, out_t) + self.bias[t] - chance[t]))
        g_n = r @ -out_n.T
        g_n -= self.bias[n] - chance[n]
        np.exp(g_n, out=g_n)
        g_n += 1
        scale = np.float32(1 / len(t))
        g_t = g_t * scale
        np.divide(-scale, g_n, out=g_n)
        out_t *= g_t[:, None]
        g_r = g_n @ out_n
        g_r += out_t
        w_n = g_n.T @ r
        self._learn_members(r, item, g_r, rng, scale, rate)
        self._step((2, 3), np.concatenate([t, n]), [np.concatenate([g_t[:, None] * r, w_n]), np.concatenate([g_t, g_n.sum(0)])], rate)
        self._step((0,), a, [g_r], rate)
        self._step((1,), b, [g_r], rate)

    def _learn_members(self, r: np.ndarray, item: np.ndarray, g_r: np.ndarray, rng: np.random.Generator, scale: np.float32, rate: float, noise: int = 2) -> None:
        """The same for members, with noise from their class; adds to ``g_r``."""
        v = self.vocabulary
        at = np.flatnonzero(item >= v.first_member)
        j = item[at] - v.first_member
        low, width = v.low[j], v.high[j] - v.low[j]
        more = width > 1
        at, j, low, width = at[more], j[more], low[more], width[more]
        if not len(at):
            return
        drawn = low[:, None] + (rng.random((len(at), noise), np.float32) * width[:, None]).astype(np.int64)
        j = np.concatenate([j[:, None], np.minimum(drawn, (low + width - 1)[:, None])], 1)
        context, out = r.take(at, axis=0), self.inner.take(j, axis=0)
        s = np.einsum("id,ikd->ik", context, out) + self.slope[j] - np.log(noise / width).astype(np.float32)[:, None]
        g = 1 / (1 + np.exp(s))
        g[:, 1:] -= 1
        g *= scale
        g_r[at] += np.einsum("ik,ikd->id", g, out)
        self._step((4, 5), j.ravel(), [(g[:, :, None] * context[:, None, :]).reshape(-1, r.shape[1]), g.ravel()], rate)

    def log10(self, a: np.ndarray, b: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each item after ``a`` and ``b``; equal contexts, and equal contexts of a class, are summed once."""
        v, context = self.vocabulary, a * len(self.vocabulary.top) + b
        context, place, of = np.unique(context, return_index=True, return_inverse=True)
        a, b, t = a[place], b[place], v.top[item]
        r = self.first.take(a, axis=0) + self.second.take(b, axis=0)
        logp = (np.einsum("ij,ij->i", r.take(of, axis=0), self.out.take(t, axis=0)) + self.bias[t]).astype(float)
        logp -= self._log_sums(a, b, r)[of]
        at = np.flatnonzero(item >= v.first_member)
        if len(at):
            member, own = item[at] - v.first_member, of[at]
            kind, row = np.unique(v.low[member] * len(context) + own, return_inverse=True)
            low, place = np.divmod(kind, len(context))
            sums, edges = np.empty(len(kind)), np.concatenate([[0], np.flatnonzero(np.diff(low)) + 1, [len(low)]])
            for i, j in zip(edges[:-1], edges[1:]):
                rows = slice(low[i], v.high[low[i]])
                sums[i:j] = _log_sum(r.take(place[i:j], axis=0), self.inner[rows], self.slope[rows])
            logp[at] += np.einsum("ij,ij->i", r.take(own, axis=0), self.inner.take(member, axis=0)) + self.slope[member] - sums[row]
        return logp / math.log(10)


    def factors(self, cells: int = 1 << 23) -> None:
        """Keep exp(first @ out.T) and exp(second @ out.T + bias), so that the sum over the outputs is an inner product of two rows; of as many
        rows as ``cells`` allow. Left out where a factor is so large or small that exactness is lost."""
        rows = min(len(self.first), cells // len(self.out))
        x, y = (np.empty((rows, len(self.out)), np.float32) for _ in range(2))
        for table, vectors, bias in ((x, self.first, np.float32(0)), (y, self.second, self.bias)):
            for k in range(0, rows, 256):
                s = np.matmul(vectors[k : min(k + 256, rows)], self.out.T, out=table[k : k + 256])
                s += bias
                with np.errstate(over="ignore"):
                    np.exp(s, out=s)
                if not (s.min() > 1e-15 and s.max() < 1e15):
                    return
        self.tables = x, y

    def _log_sums(self, a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
        """log(sum(exp(score))) over the outputs for each context; ``r`` has its vector."""
        x, y = self.tables
        near, out = np.maximum(a, b) < len(x), np.empty(len(a))
        at = np.flatnonzero(near)
        for k in range(0, len(at), 128):
            i = at[k : k + 128]
            out[i] = np.log(np.einsum("ij,ij->i", x.take(a[i], axis=0), y.take(b[i], axis=0)))
        far = np.flatnonzero(~near)
        out[far] = _log_sum(r[far], self.out, self.bias)
        return out


def _summed(grad: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; pairs of columns are added as one complex number, as time goes by columns here."""
    pairs = grad.ndim == 2 and grad.shape[1] % 2 == 0
    total = np.add.reduceat(grad.view(np.complex64) if pairs else grad, edges, axis=0)
    return total.view(np.float32) if pairs else total


def _log_sum(r: np.ndarray, w: np.ndarray, bias: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
    """log(sum(exp(r @ w.T + bias))) of each row, in parts that the processor's caches hold."""
    step, weight = max(1, cells // len(w)), np.exp(bias)
    out, part, w = np.zeros(len(r)), np.empty((min(step, len(r)), len(w)), np.float32), w.T
    for k in range(0, len(r), step):
        rows = r[k : k + step]
        s = np.matmul(rows, w, out=part[: len(rows)])
        with np.errstate(over="ignore", invalid="ignore"):
            total = np.exp(s, out=s) @ weight  # safe scores first: most matrices need no shift
        if total.min() > 1e-30 and total.max() < 1e30 and weight.min() > 1e-15:
            out[k : k + step] = np.log(total)
        else:
            s = rows @ w + bias
            most = s.max(1, keepdims=True)
            out[k : k + step] = np.log(np.exp(s - most).sum(1)) + most[:, 0]
    return out


def _tokens(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple]:
    """(first row, token ends of rows, items, counts, word numbers), each text followed by its end."""
    for row, bounds, number in batches_of_words(texts, SPACES):
        output, count = vocabulary.find(number)
        at = bounds[1:]
        output, count = np.insert(output, at, END), np.insert(count, at, vocabulary.texts)
        yield row, bounds + np.arange(len(bounds)), output, count, np.insert(number, at, 0)


def _contexts(bounds: np.ndarray, output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs one and two tokens before; before a text lies its end."""
    one = np.concatenate([[END], output[:-1]])
    two = np.concatenate([[END, END], output[:-2]])[: len(output)]
    start = bounds[:-1]
    one[start] = END
    two[start] = END
    second = start[np.diff(bounds) > 1] + 1
    two[second] = END
    return two, one


def _train(batches: Iterator[pa.RecordBatch], shared, dim: int, noise: int, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """How far each row of the parameters went, for the rows that moved, in blocks of CHUNK values."""
    vocabulary, start = shared.value
    model, rng = LogBilinear(vocabulary, dim), np.random.default_rng(3)
    if start is not None:
        model.add(start)
    before = [x.copy() for x in model.parts()]
    for batch in batches:
        for _, bounds, output, _, _ in _tokens(batch.column(0), vocabulary):
            two, one = _contexts(bounds, output)
            steps = -(-len(output) // size)
            for k in range(steps):  # tokens far from each other
                model.learn(two[k::steps], one[k::steps], output[k::steps], rng, noise)
    salt = int(rng.integers(1 << 30)) % 8
    for part, (x, y, moved) in enumerate(zip(before, model.parts(), model.moved)):
        width = 1 if x.ndim == 1 else x.shape[1]
        step = max(1, CHUNK // width)
        rows = np.flatnonzero(moved)
        edges = np.searchsorted(rows, np.arange(0, len(x) + step, step))
        for chunk, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
            if j > i:
                own = rows[i:j]
                cols = [own - chunk * step, moved[own], (y[own] - x[own]).astype(np.float16).ravel()]
                data = [c.astype(t).tobytes() for c, t in zip(cols, ("<i4", "<f4", "<f2"))]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([chunk]), pa.array([width]), pa.array([salt]), *(pa.array([d], pa.binary()) for d in data)], names=["part", "chunk", "width", "salt", "rows", "moved", "sums"])


PARTS = "part long, chunk long, width long, salt long, rows binary, moved binary, sums binary"


def _adder(first: bool):
    """Sums of the moves, weighted by the tokens that made them."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["width"].iloc[0])
        n = max(1, CHUNK // width)
        total, weight = np.zeros((n, width)), np.zeros(n)
        for r, w, x in zip(pdf["rows"], pdf["moved"], pdf["sums"]):
            r, w = np.frombuffer(r, "<i4"), np.frombuffer(w, "<f4")
            x = np.frombuffer(x, "<f2" if first else "<f4").reshape(-1, width)
            total[r] += x * w[:, None] if first else x
            weight[r] += w
        own = np.flatnonzero(weight)
        return pdf.head(1).assign(rows=[own.astype("<i4").tobytes()], moved=[weight[own].astype("<f4").tobytes()], sums=[total[own].astype("<f4").tobytes()])

    return add


def _score(batches: Iterator[pa.RecordBatch], shared, dim: int) -> Iterator[pa.RecordBatch]:
    """For each text a row of its own sums (times 0), and a row for each word that isn't known here."""
    vocabulary, moves = shared.value
    model = LogBilinear(vocabulary, dim)
    if moves is not None:
        model.add(moves)
    model.factors()
    names = ["row_id", "doc_id", "word", "times", "n_tokens", "n_known", "base", "score"]
    for batch in batches:
        for row, bounds, output, count, number in _tokens(batch.column(1), vocabulary):
            two, one = _contexts(bounds, output)
            logp = model.log10(two, one, output)
            known = count >= 0
            base = np.where(known & (count > 0), np.log10(np.maximum(count, 0) + 1.0), 0.0)
            # a word of a group has its share there; its count comes by the join
            other = (output >= vocabulary.first_member) & (output < vocabulary.first_member + vocabulary.groups)
            logp[other] -= np.log10(vocabulary.mass[output[other] - vocabulary.first_member])
            sums = [np.add.reduceat(x.astype(float), bounds[:-1]) for x in (np.ones(len(output)), known & (count > 0), base, logp)]
            n, far = len(bounds) - 1, np.flatnonzero(~known)
            doc = np.repeat(np.arange(n), np.diff(bounds))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[row : row + n]
            zeros = np.zeros(len(far))
            key = np.concatenate([ids, number[far].view(np.int64)])
            own_ids = pa.concat_arrays([batch.column(2).slice(row, n), pa.nulls(len(far), pa.int64())])
            cols = [np.concatenate([ids, ids[doc[far]]]), own_ids, key, np.concatenate([np.zeros(n, np.int64), np.ones(len(far), np.int64)])]
            cols += [np.concatenate([s, zeros]) for s in sums]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


def _trainer(shared, dim: int, noise: int):
    return lambda batches: _train(batches, shared, dim, noise)


def _scorer(shared, dim: int):
    return lambda batches: _score(batches, shared, dim)


def score_documents(docs: DataFrame, id_col="doc_id", text_col="text", outputs: int = 128, known_words: int = 1 << 16, dim: int = 16, noise: int = 64, rounds: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = rows.where(~is_held_out(F.col("doc_id"))).select("text")
    counts = settle(train.mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.count("*"), F.sum("n")).first()
    texts = train.count()
    types, tokens = total[0] + (texts > 0), (total[1] or 0) + texts
    # the most frequent words: whole bands of counts, and of the band that is too large the first parts by hash
    band, part = F.floor(F.log2("n") * 8).cast("int"), F.pmod(F.xxhash64("word", F.lit(9)), F.lit(1024))
    room, least, parts = known_words, None, 0
    for r in sorted(counts.groupBy(band.alias("b")).count().collect(), key=lambda r: -r["b"]):  # a few hundred bands
        least = r["b"]
        if r["count"] > room:
            for q in sorted(counts.where(band == least).groupBy(part.alias("part")).count().collect(), key=lambda q: q["part"]):
                if q["count"] > room:
                    break
                room, parts = room - q["count"], q["part"] + 1
            break
        room, parts = room - r["count"], 1024
    known = (band > least) | ((band == least) & (part < parts)) if least is not None else F.lit(False)
    top = counts.where(known).toPandas()
    # all other words in about as many groups as a group has words
    groups = max(1, math.isqrt(max(0, total[0] - len(top))))
    tail, far = np.zeros((groups, 2), np.int64), counts.where(~known)
    for r in far.groupBy(F.pmod("word", F.lit(groups)).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        tail[r.g] = r.n, r.types
    width = max(1, math.isqrt(len(top)))
    vocabulary = Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), outputs, texts, tokens, types, tail, width)
    moves = None
    for _ in range(rounds if texts else 0):
        shared = spark.sparkContext.broadcast((vocabulary, moves))
        sums = train.mapInArrow(_trainer(shared, dim, noise), PARTS)
        sums = sums.groupBy("part", "chunk", "salt").applyInPandas(_adder(True), PARTS).groupBy("part", "chunk").applyInPandas(_adder(False), PARTS)
        sizes = [len(vocabulary.top)] * 2 + [vocabulary.size] * 2 + [len(vocabulary.share)] * 2
        moves = moves or [np.zeros((n, 1 if k in (3, 5) else dim), np.float32) for k, n in enumerate(sizes)]
        for r in sums.toLocalIterator():  # the model's size
            weight = np.frombuffer(r.moved, "<f4")[:, None]
            moves[r.part][r.chunk * max(1, CHUNK // r.width) + np.frombuffer(r.rows, "<i4")] += np.frombuffer(r.sums, "<f4").reshape(-1, r.width) / weight
    shared = spark.sparkContext.broadcast((vocabulary, moves))
    keyed = rows.select(F.monotonically_increasing_id().alias("row_id"), "text", "doc_id")
    schema = "row_id long, doc_id long, word long, times long, n_tokens double, n_known double, base double, score double"
    made = keyed.mapInArrow(_scorer(shared, dim), schema)
    seen = F.coalesce("n", F.lit(0))
    part = F.col("times") * F.log10(seen + 1)
    met = made.join(counts, "word", "left").select("row_id", "doc_id", "n_tokens", (F.col("n_known") + F.col("times") * (seen > 0).cast("int")).alias("n_known"), (F.col("base") + part).alias("base"), (F.col("score") + part).alias("score"))
    sums = met.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return sums.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        *(F.col(c).cast("long").alias(c) for c in ("n_tokens", "n_known")),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(tokens + types + 1))).alias("base_score"),
        "score",
    )
