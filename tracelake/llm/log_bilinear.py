"""LM scoring: a log-bilinear model, trained with noise-contrastive estimation, and its unigram base.

Tokens are words with A-Z lower-cased, and one end for each text. Counts of all
tokens of all training texts are summed up by Spark. Every token has rows of
parameters, as a context and as an output: each of the FREQUENT most frequent ones
its own, the rarer ones those of their bucket by crc32. Buckets grow as the square
root of the number of rare tokens. A bucket's probability is spread over its tokens
by their smoothed counts, with one slot for unknown tokens; so probabilities over
all tokens add up to 1.

The model: a context of CONTEXT tokens gives h = sum of C_i * R[token]; the score
of output w is h . Q[w] + b[w]. The most frequent tokens (at most SHORTLIST) are
outputs of the upper level; all other words go to groups of words that end alike,
and buckets to groups of their own, about as many as a group has members that a token meets.
A group is one more output of the upper level, and its members are normalised among
themselves, so that the cost of a token grows as the root of the vocabulary. Training texts are dealt to shards by a hash of their
ids, one for each SHARD of them; each shard trains on all of its texts in the order of
their ids, in mini-batches of short runs of tokens: the upper level against shared noise drawn from the unigram
distribution, members against noise from their group, which a mini-batch's tokens of
the group share. All shards start from the same
parameters; Spark averages them, the upper level weighted by the shards' tokens, the
rows of words and buckets by how often the shard met them. So the model depends on the
texts and ids alone, not on how the table is partitioned.

A token of more than LONGEST bytes is told apart by a digest of its bytes.
Tokens up to FREQUENT most frequent ones (a bounded table) reach the tasks by
closure; the counts of all rarer tokens meet the texts' tokens in a join.

Defined cases: null texts are empty (the end alone); a null id counts as the
empty string for the hold-out; rows with equal ids are scored each; without
training tokens all scores are those of the smoothed counts; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b
from itertools import groupby, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

SHORTLIST, FREQUENT, LONGEST = 254, 60_000, 64
CONTEXT, DIM, NOISE, BATCH = 3, 16, 48, 4096
#: Noise for each member of a group; buckets for each root of the number of rare tokens; rows of parameters that travel together.
GROUP_NOISE, BUCKETS, BLOCK = 8, 4, 512
#: Words after the upper level that have groups apart from the rarer ones; groups for each member that a token meets.
COMMON, SPLIT = 10_000, 1.2
#: Texts of a shard, and of them that are cut into mini-batches together; neighbouring tokens that stay together in it.
SHARD, TEXTS, RUN = 8192, 512, 32
#: Tokens whose outputs are computed together; what they take fits into a core's cache.
ROWS = 256
#: Sums of exponentials from here to its inverse are used as they are.
LEAST = 1e-25
#: Places of a group's tokens that are multiplied with its noise at once.
TILE = 16
LEARNING_RATE = 0.25


def split_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of tokens of each text, the tokens of all texts as bytes)."""
    # White space at the end gives each text an empty string as its last, its end token, as no word is empty; at the beginning it gives one more.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.binary_join_element_wise(texts.fill_null(""), "", " ")))
    n, words = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()
    sizes = pc.binary_length(words).to_numpy()
    kept = sizes > 0
    kept[np.cumsum(n) - 1] = True
    words = words.cast(pa.binary())
    if not kept.all():
        n, words, sizes = np.add.reduceat(kept, np.cumsum(n) - n, dtype=np.int64), words.filter(pa.array(kept)), sizes[kept]
    if sizes.max(initial=0) > LONGEST:
        words = pa.array([w if len(w) <= LONGEST else b"\0" + blake2b(w, digest_size=20).digest() for w in words.to_pylist()], pa.binary())
    return n, words


def tokens_of(text: str | None) -> list[bytes]:
    return split_tokens(pa.array([text], pa.string()))[1].to_pylist()


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(7)) == 2


def token_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(token, n) over all rows, added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            out = pa.concat_tables(held).group_by("token").aggregate([("n", "sum")])
            held.clear()
            return out.select(["token", "n_sum"]).rename_columns(["token", "n"]).combine_chunks()

        for batch in batches:
            for row in range(0, batch.num_rows, 4 * TEXTS):
                found = pc.value_counts(split_tokens(batch.column(0).slice(row, 4 * TEXTS))[1])
                held.append(pa.table({"token": found.field(0), "n": found.field(1)}))
                if sum(map(len, held)) > 1_000_000:
                    held.append(added())
                    if len(held[0]) > 500_000:
                        yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def frequent_tokens(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Tokens with at least the count that at most ``most`` tokens reach; by falling count."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    # Distinct counts above the cut number at most ``most``; the rest need not reach the driver.
    least, total = None, 0
    for n, k in sizes.orderBy(F.desc("n")).limit(most + 1).collect():
        total += k
        if total > most:
            break
        least = n
    if least is None:
        return []
    found = counts.where(F.col("n") >= least).collect()
    return sorted(((bytes(r["token"]), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


def sums_by_row(rows: np.ndarray, values: np.ndarray, n: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows of ``n``, sums of their values, sums of ``times``, by default their numbers)."""
    flags, place = np.zeros(n, bool), np.zeros(n, np.int64)
    flags[rows if times is None else rows[times > 0]] = True
    found = np.flatnonzero(flags)
    place[found] = np.arange(len(found))
    # Rows that count no time have sums of 0, which the first place takes.
    at = place.take(rows)
    return found, added_rows(at, values, len(found)), np.bincount(at, times, len(found))


def put_rows(x: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``x[rows] = values``, each row moved as one item."""
    if x.ndim > 1:
        item = f"V{x.itemsize * x.shape[1]}"
        x, values = x.view(item), values.view(item)
    np.put(x, rows, values)


def added_rows(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the sum of the values that go to it; an odd number of columns gets one more of zeros."""
    if values.shape[1] % 2:
        values = np.concatenate([values, np.zeros((len(values), 1), np.float32)], axis=1)
    # Two floats go as one complex number, and flat arrays are added up many times faster than rows.
    pairs, width = np.ascontiguousarray(values).view(np.complex64), values.shape[1] // 2
    sums, of = np.zeros(n * width, np.complex64), np.arange(width)
    for some in range(0, len(at), TEXTS):
        places = at[some : some + TEXTS, None] * width + of
        np.add.at(sums, places.ravel(), pairs[some : some + TEXTS].ravel())
    return sums.view(np.float32).reshape(n, 2 * width)


def wrongs(logits: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-logits)), in place."""
    np.negative(logits, out=logits)
    np.exp(logits, out=logits)
    logits += 1
    return np.reciprocal(logits, out=logits)


def with_ones(h: np.ndarray) -> np.ndarray:
    """``h`` with a column of ones, which biases meet."""
    return np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)


def log_sums(h: np.ndarray, q: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-probability of the chosen ones among all outputs ``q``, whose last column is the bias; for ``h`` with a column of ones."""
    sums, ones, turned = np.empty(len(h), np.float32), np.ones(len(q), np.float32), np.ascontiguousarray(q.T)
    room = np.empty((min(ROWS, len(h)), len(q)), np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        for at in range(0, len(h), ROWS):
            some = h[at : at + ROWS]
            logits = np.matmul(some, turned, out=room[: len(some)])
            np.matmul(np.exp(logits, out=logits), ones, out=sums[at : at + ROWS])
        out = np.einsum("md,md->m", h, q.take(chosen, 0)) - np.log(sums)
    # Sums that overflow or nearly vanish are taken again, from the largest logit.
    again = np.flatnonzero(~((sums > LEAST) & (sums < 1 / LEAST)))
    for at in range(0, len(again), ROWS):
        some = again[at : at + ROWS]
        logits = h[some] @ turned
        logits -= logits.max(1, keepdims=True)
        out[some] = logits[np.arange(len(some)), chosen[some]] - np.log(np.exp(logits) @ ones)
    return out


class LogBilinear:
    """Parameters, training steps and normalised log-probabilities.

    ``unigram``: weights of the tokens by id, first those of the upper level, then
    the members of the groups; ``offsets``: where groups begin among the members, and
    their end.
    """

    def __init__(self, unigram: np.ndarray, seed: int = 5, offsets: np.ndarray | None = None):
        self.n = len(unigram)
        self.offsets = np.zeros(1, np.int64) if offsets is None else offsets
        weights = np.maximum(unigram, 1e-9)
        members = int(self.offsets[-1])
        self.head = self.n - members
        sizes = np.diff(self.offsets)
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        self.top = np.concatenate([np.arange(self.head), self.head + self.group])
        totals = np.add.reduceat(weights[self.head :], self.offsets[:-1]) if members else np.empty(0)
        self.unigram = np.concatenate([weights[: self.head], totals]) / weights.sum()
        within = weights[self.head :] / totals[self.group]
        self.upto = np.cumsum(within)  # each group adds 1
        self.upto_top = np.cumsum(self.unigram)
        draw = np.random.default_rng(seed)
        # The context tables have one row more, for places before the text.
        self.r = draw.normal(0, 0.1, (self.n + 1, DIM)).astype(np.float32)
        self.q = draw.normal(0, 0.1, (len(self.unigram), DIM)).astype(np.float32)
        self.c = np.full((CONTEXT, DIM), 1 / CONTEXT, np.float32)
        self.b = np.log(self.unigram).astype(np.float32)
        self.qm = np.zeros((members, DIM), np.float32)
        self.bm = np.log(within).astype(np.float32)
        self.log_k = np.log(NOISE * self.unigram).astype(np.float32)
        self.log_km = np.log(GROUP_NOISE * within).astype(np.float32)

    NAMES = ("r", "q", "c", "b", "qm", "bm")

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for name in self.NAMES:
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def rows(self) -> np.ndarray:
        """All parameters as rows of DIM + 1: upper level, places, contexts, members."""
        wide = lambda x, last: np.concatenate([x, last[:, None]], axis=1)
        none = np.zeros(max(CONTEXT, self.n + 1), np.float32)
        return np.concatenate([wide(self.q, self.b), wide(self.c, none[:CONTEXT]), wide(self.r, none[: self.n + 1]), wide(self.qm, self.bm)])

    def load_rows(self, rows: np.ndarray) -> LogBilinear:
        q, c, r, qm = np.split(rows.astype(np.float32), np.cumsum([len(self.q), CONTEXT, self.n + 1]))
        self.q, self.b, self.c, self.r, self.qm, self.bm = (x.copy() for x in (q[:, :DIM], q[:, DIM], c[:, :DIM], r[:, :DIM], qm[:, :DIM], qm[:, DIM]))
        return self

    def row_weights(self, seen: int, state: dict) -> np.ndarray:
        """How often training met each of ``rows``; the upper level counts as met by every token."""
        return np.concatenate([np.full(len(self.q) + CONTEXT, float(seen)), state["met_r"], state["met_qm"]])

    def vectors(self, contexts: np.ndarray) -> np.ndarray:
        """(CONTEXT, batch, DIM): the rows of contexts."""
        return self.r.take(contexts.T.ravel(), 0).reshape(CONTEXT, -1, DIM)

    def hidden(self, vectors: np.ndarray) -> np.ndarray:
        h = vectors[0] * self.c[0]
        for v, c in zip(vectors[1:], self.c[1:], strict=True):
            h += v * c
        return h

    def _step(self, state: dict, name: str, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        """An AdaGrad step of all or some distinct rows."""
        x = getattr(self, name)
        if name not in state:
            state[name] = np.ones_like(x)
        s = state[name]
        near = g * g
        near += s if rows is None else s.take(rows, 0)
        moved = g / np.sqrt(near)
        moved *= LEARNING_RATE
        if rows is None:
            s[:] = near
            x -= moved
        else:
            put_rows(s, rows, near)
            put_rows(x, rows, x.take(rows, 0) - moved)

    def _train_members(self, h: np.ndarray, members: np.ndarray, draw: np.random.Generator, state: dict) -> np.ndarray:
        """Members, ordered by group, against draws from their groups, which the batch's tokens of a group share; the gradient of h."""
        groups, firsts, sizes = np.unique(self.group[members], return_index=True, return_counts=True)
        drawn = np.searchsorted(self.upto, groups[:, None] + np.sort(draw.random((len(groups), GROUP_NOISE))), side="right")
        drawn = np.clip(drawn, self.offsets[groups][:, None], self.offsets[groups + 1][:, None] - 1)
        # Tokens lie in tiles of TILE places, each of one group; places left over stay empty.
        tiles = -(-sizes // TILE)
        drawn = drawn.repeat(tiles, 0)
        places = np.arange(len(members)) + np.repeat((np.cumsum(tiles) - tiles) * TILE - firsts, sizes)
        filled = np.zeros((len(drawn) * TILE, DIM + 1), np.float32)
        filled[places] = h1 = with_ones(h)
        filled = filled.reshape(len(drawn), TILE, DIM + 1)
        bias = self.bm - self.log_km
        qt, qn = self.qm.take(members, 0), self.qm.take(drawn, 0)
        logits = filled @ np.concatenate([qn, bias[drawn][:, :, None]], axis=2).transpose(0, 2, 1)
        wrong_t, wrong_n = wrongs(np.einsum("md,md->m", h, qt) + bias[members]) - 1, wrongs(logits)
        wrong_n *= filled[:, :, DIM:]
        gh = (wrong_n @ qn).reshape(-1, DIM).take(places, 0)
        gh += wrong_t[:, None] * qt
        noise = wrong_n.transpose(0, 2, 1) @ filled
        rows, values = np.concatenate([members, drawn.ravel()]), np.concatenate([wrong_t[:, None] * h1, noise.reshape(-1, DIM + 1)])
        within = filled[:, :, DIM].sum(1)
        at, sums, met = sums_by_row(rows, values, len(self.qm), np.concatenate([np.ones(len(members)), np.repeat(within, GROUP_NOISE)]))
        sums /= np.sqrt(met, dtype=np.float32)[:, None]
        self._step(state, "qm", sums[:, :DIM], at)
        self._step(state, "bm", sums[:, DIM], at)
        state["met_qm"][at] += met
        return gh

    def train(self, contexts: np.ndarray, targets: np.ndarray, draw: np.random.Generator, state: dict) -> None:
        """One mini-batch of tokens, each with its own context."""
        self.train_runs(np.concatenate([contexts[:, ::-1], targets[:, None]], axis=1), draw, state)

    def train_runs(self, runs: np.ndarray, draw: np.random.Generator, state: dict) -> None:
        """One mini-batch: targets against NOISE shared draws, members of groups against GROUP_NOISE each; AdaGrad steps.

        A row of ``runs`` has CONTEXT ids and the targets that follow them, so that a
        token's row is read and moved once for all contexts that it is in. The start is no target.
        """
        if "met_r" not in state:
            state |= {"met_r": np.zeros(self.n + 1), "met_qm": np.zeros(len(self.qm))}
        noise = np.minimum(np.searchsorted(self.upto_top, draw.random(NOISE), side="right"), len(self.unigram) - 1)
        before, length = runs[:, :-1], runs.shape[1] - CONTEXT
        real = runs[:, CONTEXT:] != self.n
        kept = np.flatnonzero(real)
        targets = runs[:, CONTEXT:].ravel().take(kept)
        behind = [slice(CONTEXT - 1 - j, CONTEXT - 1 - j + length) for j in range(CONTEXT)]
        tops, vectors = self.top[targets], self.r.take(before, 0)
        h = vectors[:, behind[0]] * self.c[0]
        for some, c in zip(behind[1:], self.c[1:], strict=True):
            h += vectors[:, some] * c
        h = h.reshape(-1, DIM).take(kept, 0)
        qt, qn = self.q.take(tops, 0), self.q[noise]
        bias = self.b - self.log_k
        wrong_t, wrong_n = wrongs(np.einsum("md,md->m", h, qt) + bias[tops]) - 1, wrongs(h @ qn.T + bias[noise])
        gh = wrong_t[:, None] * qt + wrong_n @ qn
        grow = added_rows(tops, wrong_t[:, None] * h, len(self.q))
        np.add.at(grow, noise, wrong_n.T @ h)
        gb = (np.bincount(tops, wrong_t, len(self.q)) + np.bincount(noise, wrong_n.sum(0), len(self.q))).astype(np.float32)
        inside = np.flatnonzero(targets >= self.head)
        if len(inside):
            inside = inside[np.argsort(tops[inside].astype(np.uint16 if len(self.q) < 1 << 16 else np.int64), kind="stable")]
            put_rows(gh, inside, gh.take(inside, 0) + self._train_members(h.take(inside, 0), targets[inside] - self.head, draw, state))
        wide, gc, gr, times = np.zeros((real.size, DIM), np.float32), np.empty_like(self.c), np.zeros_like(vectors), np.zeros(before.shape)
        put_rows(wide, kept, gh)
        wide = wide.reshape(*real.shape, DIM)
        for j, some in enumerate(behind):
            gc[j] = np.einsum("mld,mld->d", wide, vectors[:, some])
            gr[:, some] += wide * self.c[j]
            times[:, some] += real
        at, sums, met = sums_by_row(before.ravel(), gr.reshape(-1, DIM), len(self.r), times.ravel())
        state["met_r"][at] += met
        scale = np.float32(len(targets) ** 0.5)
        for name, g in (("q", grow), ("b", gb), ("c", gc)):
            self._step(state, name, g / scale)
        self._step(state, "r", sums / np.sqrt(met, dtype=np.float32)[:, None], at)

    def log_probability(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of targets: the upper level's outputs, then the members of a target's group."""
        h, tops = np.ones((len(targets), DIM + 1), np.float32), self.top[targets]
        for at in range(0, len(h), BATCH):
            h[at : at + BATCH, :DIM] = self.hidden(self.vectors(contexts[at : at + BATCH]))
        out = log_sums(h, np.concatenate([self.q, self.b[:, None]], axis=1), tops)
        order = np.argsort(tops)
        order = order[np.searchsorted(tops[order], self.head) :]
        ends = np.flatnonzero(np.diff(tops[order], append=-1)) + 1
        members = np.concatenate([self.qm, self.bm[:, None]], axis=1)
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
            some = order[start:end]
            first, last = self.offsets[tops[some[0]] - self.head :][:2]
            out[some] += log_sums(h[some], members[first:last], targets[some] - self.head - first)
        return out


def windows(ids: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, targets) of texts' output ids; ``start`` stands before each text."""
    pad = np.full(CONTEXT, start, np.int64)
    padded = [np.concatenate([pad, x]) for x in ids]
    contexts = np.concatenate([np.stack([x[CONTEXT - 1 - i : len(x) - 1 - i] for i in range(CONTEXT)], axis=1) for x in padded])
    return contexts, np.concatenate(ids)


def runs_of(ids: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """Runs of RUN tokens, with the CONTEXT tokens before them, of texts of ``n`` ids each; ``start`` stands before each text and after the last."""
    places = np.arange(len(ids)) + CONTEXT * np.repeat(np.arange(1, len(n) + 1), n)
    out = np.full(CONTEXT + -(-(int(places[-1]) + 1 - CONTEXT) // RUN) * RUN, start, np.int64)
    out[places] = ids
    return np.lib.stride_tricks.sliding_window_view(out, CONTEXT + RUN)[::RUN]


class Vocabulary:
    """Ids of tokens: the upper level, then the groups' members: COMMON words, rarer ones, buckets.

    Groups are runs of words in the order of their reversed bytes, as words that end
    alike stand in like places. ``frequent``: (token, count) by falling count;
    ``buckets``: counts and numbers of the rarer tokens by bucket.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], buckets: np.ndarray):
        head, k = min(SHORTLIST, len(frequent)), len(buckets)
        counts, weights = np.array([n for _, n in frequent], float), np.maximum(1.0, buckets[:, 0])
        members, every = len(frequent) - head + k, np.concatenate([counts, weights])
        common = min(head + COMMON, len(frequent))
        groups: list[np.ndarray] = []
        for first, last in ((head, common), (common, len(frequent)), (len(frequent), len(every))):
            some = np.array(sorted(range(first, last), key=lambda i: frequent[i][0][::-1]) if last <= len(frequent) else range(first, last), np.int64)
            # A token meets all groups, and on average the members of one by the share of tokens that are in these groups.
            parts = min(len(some), int(np.ceil(SPLIT * (len(some) * every[some].sum() / every.sum()) ** 0.5)))
            groups += np.array_split(some, parts) if len(some) else []
        ids = np.arange(head + members)
        ids[np.concatenate([ids[:head], *groups])] = np.arange(head + members)
        self.known = {w: i for (w, _), i in zip(frequent, ids[: len(frequent)].tolist(), strict=True)}
        self.bucket = ids[len(frequent) :].tolist()
        self.offsets = np.append(0, np.cumsum([len(x) for x in groups])).astype(np.int64)
        self.unigram = np.empty(head + members)
        self.unigram[ids] = every
        #: Counts of words, as in the base; 0 for buckets, whose tokens' counts come by a join.
        self.log_count = np.zeros(head + members)
        self.log_count[ids[: len(frequent)]] = np.log10(counts + 1)
        #: What a bucket's smoothed counts add up to, unknown tokens included; 0 for words.
        self.log_share = np.zeros(head + members)
        self.log_share[ids[len(frequent) :]] = np.log10(buckets.sum(1) + 1)

    @cached_property
    def table(self) -> tuple[pa.Array, np.ndarray]:
        """Frequent tokens and their ids, made once in each task."""
        return pa.array(self.known, pa.binary()), np.fromiter(self.known.values(), np.int64, len(self.known))

    def ids(self, words: pa.Array) -> np.ndarray:
        known, ids = self.table
        each = words.dictionary_encode()
        found = pc.index_in(each.dictionary, value_set=known).fill_null(-1).to_numpy()
        rare, k = np.flatnonzero(found < 0), len(self.bucket)
        out = np.append(ids, -1)[found]
        out[rare] = [self.bucket[crc32(w) % k] for w in each.dictionary.take(pa.array(rare)).to_numpy(zero_copy_only=False)]
        return out.take(each.indices.to_numpy())


def rare_buckets(counts: DataFrame, frequent: list[tuple[bytes, int]], n_types: int) -> np.ndarray:
    """Counts and numbers of the tokens that are not frequent, by bucket."""
    k = max(1, int(np.ceil(BUCKETS * (n_types - len(frequent)) ** 0.5)))
    out = np.zeros((k, 2))
    rare = counts.where(F.col("n") < frequent[-1][1]) if frequent else counts
    for r in rare.groupBy((F.crc32("token") % k).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():  # one row for each bucket
        out[r["k"]] = r["n"], r["types"]
    return out


def trained(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> LogBilinear:
    """The model averaged over shards, each trained on all of its rows."""
    start, width = len(vocabulary.unigram), 4 * (DIM + 2)
    shards = max(1, -(-docs.count() // SHARD))

    def shard_rows(shard: int, texts: Iterator[str | None]) -> Iterator[pa.RecordBatch]:
        model, state, seen = LogBilinear(vocabulary.unigram, offsets=vocabulary.offsets), {}, 0
        draw = np.random.default_rng(shard)
        for some in iter(lambda: list(islice(texts, TEXTS)), []):
            n, words = split_tokens(pa.array(some, pa.string()))
            runs = runs_of(vocabulary.ids(words), n, start)
            order = draw.permutation(len(runs))
            for at in range(0, len(order), BATCH // RUN):
                model.train_runs(runs[order[at : at + BATCH // RUN]], draw, state)
            seen += len(words)
        weights = model.row_weights(seen, state)[:, None]
        rows = np.concatenate([model.rows() * weights, weights], axis=1).astype("<f4")
        for at in range(0, len(rows), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([rows[at : at + BLOCK].tobytes()], pa.binary())], names=["block", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, t) for batch in batches for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for shard, some in groupby(rows, lambda r: r[0]):
            yield from shard_rows(shard, (t.as_py() for _, t in some))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), "<f4").astype(float)
                sums[block] = sums[block] + x if block in sums else x
        for block, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], names=["block", "v"])

    schema = "block int, v binary"
    by_shard = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(shards))
    rows = docs.select(by_shard.alias("shard"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "id", "text").select("shard", "text")
    parts = rows.mapInArrow(run, schema)
    found = parts.repartition("block").mapInArrow(added, schema).collect()  # one row for each block of parameters
    model = LogBilinear(vocabulary.unigram, offsets=vocabulary.offsets)
    if found:
        flat = np.frombuffer(b"".join(bytes(r["v"]) for r in sorted(found, key=lambda r: r["block"])), "<f4").reshape(-1, width // 4)
        weights = flat[:, -1:]
        # Rows that no shard met stay as they are.
        model.load_rows(np.where(weights > 0, flat[:, :-1] / np.maximum(weights, 1e-9), model.rows()))
    return model


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    train = rows.where("not held_out")
    counts = stored(token_counts(train), "counts")
    n_train, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = frequent_tokens(counts, FREQUENT)
    vocabulary = Vocabulary(frequent, rare_buckets(counts, frequent, n_types))
    model = trained(train, vocabulary, id_col=id_col)

    start = len(vocabulary.unigram)
    is_bucket = np.zeros(start, bool)
    is_bucket[vocabulary.bucket] = True
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                some = batch.slice(row, 512)
                n, words = split_tokens(some.column("text"))
                ids, ends = vocabulary.ids(words), np.cumsum(n)
                starts, at_rare = ends - n, np.flatnonzero(is_bucket[ids])
                edges = np.searchsorted(at_rare, np.append(0, ends))
                contexts, targets = windows(np.split(ids, starts[1:]), start)
                logp = model.log_probability(contexts, targets).astype(float) / np.log(10)
                base, score, shared = (np.add.reduceat(x, starts) for x in (vocabulary.log_count[ids], logp, vocabulary.log_share[ids]))
                key = part + at + np.arange(len(n))
                at += len(n)
                columns = [pa.array(key), some.column(id_col), some.column("held_out"), *map(pa.array, (n, n - np.diff(edges), base, score, shared))]
                rare = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words.take(pa.array(at_rare)))
                yield pa.RecordBatch.from_arrays([*columns, rare], names=["key", id_col, "held_out", "n_tokens", "n_frequent", "base", "model", "shared", "rare"])

    schema = f"key bigint, `{id_col}` {kind}, held_out boolean, n_tokens bigint, n_frequent bigint, base double, model double, shared double, rare array<binary>"
    scored = stored(rows.select(id_col, "text", "held_out").mapInArrow(run, schema), "scored")
    # Rare tokens meet their counts; each is rarer than FREQUENT others, so no key is hot.
    seen = scored.select("key", F.explode("rare").alias("token")).join(counts, "token").groupBy("key").agg(F.count(F.lit(1)).alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log"))
    out = scored.drop("rare").join(seen, "key", "left")
    log_all = float(np.log10(n_train + n_types + 1))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("model") + rare_log - F.col("shared")).alias("score"),
    )
