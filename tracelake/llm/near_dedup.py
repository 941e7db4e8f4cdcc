"""Near-duplicate groups: SetSketch registers, banded, estimated by likelihood, then verified on full sets.

A document's set holds its distinct word shingles, told apart by 64-bit digests.
Each of the M registers keeps the least of exponentially distributed values of
the set's elements, rounded on an exponential scale of base B (a SetSketch:
registers merge by maximum, and equal registers grow likelier with the overlap).

1. Sets that are equal (by 128-bit digest) form one class, represented by its
   smallest id, so copies never meet as pairs.
2. Classes that agree on all registers of a band share a bucket. With BANDS
   bands of ROWS registers, a pair at similarity 0.8 misses all of them with
   probability 5e-9, at 0.85 with 6e-13.
3. Each class meets the smallest class that it shares a bucket with, not every
   other. Pairs whose joint likelihood puts the similarity SLACK standard errors
   or more under the threshold go; the rest are verified on the full sets.
   Verified pairs join components.
4. Pairs within one component need no look: they are connected already. In
   buckets that hold several components, the classes outside the largest meet its
   smallest class in the same way. In those that still do, they are compared with
   those of other components, as arrays of registers and then by their LOW smallest
   digests; only close pairs become rows and are verified.

Defined cases: texts without words have an empty set and link with nothing;
texts with fewer words than a shingle have their whole sequence as one; null
ids link with nothing; rows with equal ids are one node. Extra columns of
``docs`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.components import connected_components

BANDS, ROWS = 48, 5
M = BANDS * ROWS
#: Base of the registers' scale, rate of the exponentials, largest register.
B, RATE, LARGEST = 1.001, 20.0, 65535
#: Standard errors under the threshold from which a pair is ruled out by its registers (one in 3 million at the threshold).
SLACK = 5
#: Smallest digests of a set that travel with it, in a row of bounded size.
LOW = 192
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_draws = np.random.default_rng(20240131)
_MULTIPLY = _draws.integers(0, 2**31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _draws.integers(0, 2**32, M, dtype=np.uint32)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of the shingles of ``k`` words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and \x20\x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _MIX1 + h[i : len(h) - k + 1 + i]
    out = (out ^ (out >> np.uint64(31))) * _MIX2
    return np.unique(out ^ (out >> np.uint64(32)))


def registers(elements: np.ndarray) -> np.ndarray:
    """M registers of a set that is not empty."""
    least = np.full(M, 2**32 - 1, np.uint32)
    low = elements.astype(np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, ((low[at : at + 2048, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)) + 32768, 0, LARGEST).astype("<u2")


def likely_similarity(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from register order counts and set sizes, on a grid of 200."""
    more, less = (u > v).sum(1)[:, None], (u < v).sum(1)[:, None]
    a, b = (nu / (nu + nv))[:, None], (nv / (nu + nv))[:, None]
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(a / b, b / a)
    prob = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    p, q = np.clip(prob(a - b * j), 1e-12, 1), np.clip(prob(b - a * j), 1e-12, 1)
    log_likelihood = more * np.log(p) + less * np.log(q) + (u.shape[1] - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))
    return np.take_along_axis(j, log_likelihood.argmax(1)[:, None], 1)[:, 0]


def reaches(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, least: float) -> np.ndarray:
    """Whether the maximum-likelihood similarity of pairs is ``least`` or more.

    The log-likelihood has one peak, so it lies above ``least`` where the
    likelihood still rises there.
    """
    more, less = (u > v).sum(1), (u < v).sum(1)
    a, b = nu / (nu + nv), nv / (nu + nv)
    prob = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12, 1)

    def log_likelihood(j: float) -> np.ndarray:
        p, q = prob(a - b * j), prob(b - a * j)
        return more * np.log(p) + less * np.log(q) + (u.shape[1] - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))

    return log_likelihood(least + 0.001) >= log_likelihood(least - 0.001)


def set_sketches(docs: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, digest, regs, low) for every row; low: the LOW smallest digests, cut to 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, regs, low = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                regs.append(registers(s).tobytes() if len(s) else None)
                low.append(np.unique(s.astype("<u4"))[:LOW].tobytes())
            columns = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, regs, low))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_shingles", "digest", "regs", "low"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, n_shingles bigint, digest binary, regs binary, low binary")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that sizes and registers do not rule out."""
    at = threshold / 100
    least = at - SLACK * np.sqrt(at * (1 - at) / M)
    side = lambda x: classes.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(0, batch.num_rows, 1000):
                part = batch.slice(at_row, 1000)
                u, v = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("ra", "rb"))
                nu, nv = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
                keep = pa.array(reaches(u, v, nu, nv, least))
                yield part.select(["a", "b"]).filter(keep)

    kind = dict(both.dtypes)["a"]
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, f"a {kind}, b {kind}")


#: Classes outside the largest component that a task holds at once, and classes that stream past them in one task.
OUTSIDE, STREAM = 256, 8192


def _close(a: bytes, b: bytes, na: int, nb: int, threshold: int) -> bool:
    """Whether the LOW smallest digests of two sets leave the threshold possible.

    Sets of no more than LOW are there as a whole; for others the bound lies
    SLACK standard errors of the estimate under the threshold. The 2 makes up for
    digests that are equal when cut.
    """
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both, either = np.intersect1d(x, y, assume_unique=True), np.union1d(x, y)
    at, slack = threshold / 100, 0.0
    if max(na, nb) > LOW:
        either = either[:LOW]
        both = both[: np.searchsorted(both, either[-1], "right")]
        size = (na + nb) / (1 + at)
        slack = SLACK * np.sqrt(at * (1 - at) / len(either) * max(0.0, 1 - len(either) / size))
    return (len(both) + 2) / max(1, len(either) - 2) >= at - slack


def _across(mixed: DataFrame, threshold: int) -> DataFrame:
    """Close pairs (a, b) of different components in a bucket, each pair once: in the first band that it shares.

    In each bucket the classes outside its largest component are held in chunks
    of OUTSIDE and all classes stream past them; a large bucket is dealt out to
    several tasks by chunk and by hash. Pairs are compared as arrays of registers,
    those that they leave likely by their smallest digests; only the close become
    rows, so a large group just under the threshold sends no texts around.
    """
    at = threshold / 100
    least = at - SLACK * np.sqrt(at * (1 - at) / M)
    spread = lambda n: F.sequence(F.lit(0), (F.greatest(n, F.lit(1)) - 1).cast("int"))
    chunks, salts = F.ceil((F.col("n_all") - F.col("n_main")) / OUTSIDE), F.ceil(F.col("n_all") / STREAM)
    rows = mixed.withColumns({"chunks": chunks, "salts": salts, "h": F.xxhash64("doc")})
    held = rows.where("component <> main").withColumns({"chunk": F.pmod("h", "chunks").cast("int"), "salt": F.explode(spread(F.col("salts"))), "side": F.lit(0)})
    passing = rows.withColumns({"salt": F.pmod(F.shiftright("h", 20), "salts").cast("int"), "chunk": F.explode(spread(F.col("chunks"))), "side": F.lit(1)})
    columns = ["bucket", "chunk", "salt", "side", "band", "doc", "component", "main", "n_shingles", "regs", "low"]
    both = held.select(*columns).unionByName(passing.select(*columns)).repartition("bucket", "chunk", "salt").sortWithinPartitions("bucket", "chunk", "salt", "side", "doc")

    def compare(outside: list[dict], o: np.ndarray, batch: list[dict]) -> Iterator[tuple]:
        v = np.frombuffer(b"".join(x["regs"] for x in batch), "<u2").reshape(-1, M)
        column = lambda rows, name: np.array([x[name] for x in rows])
        vn, on, vd, od, vc, oc = (column(rows, name) for name in ("n_shingles", "doc", "component") for rows in (batch, outside))
        # Not connected already, and seen from one side only.
        near = (vc[:, None] != oc) & ((vc == batch[0]["main"])[:, None] | (od < vd[:, None]))
        near &= 100 * np.minimum(vn[:, None], on) >= threshold * np.maximum(vn[:, None], on)
        near &= np.stack([(o == row).sum(1) for row in v]) >= (least - 0.03) * M
        i, j = np.nonzero(near)
        if not len(i):
            return
        # Each pair once: in the first band that it shares.
        here = (o[j] == v[i]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == batch[0]["band"]
        i, j = i[here], j[here]
        likely = reaches(v[i], o[j], vn[i].astype(float), on[j].astype(float), least)
        for i, j in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
            y, x = batch[i], outside[j]
            if _close(x["low"], y["low"], x["n_shingles"], y["n_shingles"], threshold):
                yield min(x["doc"], y["doc"]), max(x["doc"], y["doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outside, o = None, [], None
        for batch in batches:
            for at_row in range(0, batch.num_rows, 512):
                found, waiting = [], []
                for x in batch.slice(at_row, 512).to_pylist():
                    if (now := (x["bucket"], x["chunk"], x["salt"])) != key:
                        if waiting:
                            found += compare(outside, o, waiting)
                        key, outside, o, waiting = now, [], None, []
                    if x["side"] == 0:
                        outside.append(x)
                    elif outside:
                        if o is None:
                            o = np.frombuffer(b"".join(y["regs"] for y in outside), "<u2").reshape(-1, M)
                        waiting.append(x)
                if waiting:
                    found += compare(outside, o, waiting)
                if found:
                    kind = batch.schema.field("doc").type
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], names=["a", "b"])

    kind = dict(both.dtypes)["doc"]
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda x: texts.select(F.col("doc").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # neighbours share their first text
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                ta = ta.as_py()
                if own is None or ta != last:
                    last, own = ta, shingle_set(ta, k)
                other = shingle_set(tb.as_py(), k)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= threshold * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(both.dtypes)["a"]
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def _mixed(members: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """The members of buckets of at least ``least`` that hold several components, with component, and of the bucket's largest component its label (main), smallest class (lead) and size.

    The buckets are written before they meet their members, so that Spark can
    split a bucket that holds very many of them.
    """
    placed = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(*members.columns, F.coalesce("component", "doc").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lead"))
    largest = F.max(F.struct("n", "component", "lead")).alias("top")
    buckets = parts.groupBy("bucket").agg(largest, F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k")).where(f"k > 1 and n_all >= {least}")
    buckets = stored(buckets.select("bucket", F.col("top.component").alias("main"), F.col("top.lead").alias("lead"), F.col("top.n").alias("n_main"), "n_all"), "components")
    return placed.join(buckets, "bucket")


def near_groups(docs: DataFrame, *, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id) for every row; threshold in hundredths of intersection over union."""
    rows = stored(set_sketches(docs, words, id_col=id_col, text_col=text_col), "sketches")
    some = rows.where("doc is not null and n_shingles > 0")
    classes = stored(some.groupBy("digest", "n_shingles", "regs", "low").agg(F.min("doc").alias("doc")), "classes")
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    size = 2 * ROWS
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {size} + 1, {size})))")
    banded = classes.select("doc", F.posexplode(keys).alias("band", "bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = stored(banded.join(stored(hubs, "hubs"), "bucket"), "buckets")
    linked = lambda pairs: stored(_verified(pairs, texts, words, threshold), "links")

    first = members.where("doc <> hub").groupBy(F.col("doc").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    edges = linked(_likely(first, classes, threshold))
    labels = connected_components(edges)

    # Buckets that hold several components: what lies outside the largest meets its smallest class.
    mixed = stored(_mixed(members.drop("hub"), labels), "mixed")
    second = mixed.where("component <> main").select(F.least("lead", "doc").alias("a"), F.greatest("lead", "doc").alias("b")).distinct()
    found = linked(_likely(second, classes, threshold))
    if found.limit(1).count():
        edges = edges.unionByName(found)
        labels = connected_components(edges)

    # Buckets that still hold several: what lies outside the largest meets the rest. The smallest class has met all by now.
    rest = stored(_mixed(mixed.select("bucket", "band", "doc", F.col("lead").alias("met")), labels, least=3).where("doc <> met"), "rest")
    found = linked(_across(rest.join(classes.select("doc", "n_shingles", "regs", "low"), "doc"), threshold))
    if found.limit(1).count():
        labels = connected_components(edges.unionByName(found))

    of_class = classes.select("digest", F.col("doc").alias("_class"))
    out = rows.join(of_class, "digest", "left").join(labels.withColumnRenamed("node", "_class"), "_class", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "_class"))
    return out.select("doc", "n_shingles", F.coalesce(own, F.col("doc")).alias("component_id"))


def near_dedup(docs: DataFrame, *, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its group.

    Rows that repeat a kept id all stay; rows with a null id stay.
    """
    groups = near_groups(docs, words=words, threshold=threshold, id_col=id_col, text_col=text_col)
    gone = stored(groups.where("component_id <> doc").select(F.col("doc").alias(id_col)).distinct(), "gone")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
