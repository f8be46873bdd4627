"""Groups of near-duplicate texts by probability min-hashing, banding and exact verification.

A text's shingles are its runs of ``words`` consecutive words (maximal runs of letters and digits,
lower-cased), each distinct one with weight 1 or, if asked for, its count. Every shingle is a Poisson
process whose rate is its weight; each arrival hits a random component of the signature, which keeps
the shingle of its earliest arrival. Two signatures agree in a component with the probability
Jaccard similarity, which for equal weights is the Jaccard similarity. A process is followed no
longer than an arrival can still be the earliest of some component.

Texts whose signatures agree in a whole band meet in a bucket. Pairs from the buckets whose signatures
agree in so few components that their likeness cannot reach the threshold are dropped (six standard
deviations below it: the chance to lose a pair by this is 1e-9, that of the banding `MISS`); all others
are verified exactly on whole texts. For the groups no bucket emits all its pairs: first every member is
compared with the bucket's smallest id only; the links found make components; then only members of one
bucket that are still in different components are compared, those outside the bucket's largest component
with all others. So all candidates of the banding that could join two components are decided, while a
bucket of copies of one page costs as many comparisons as it has members. Only where the links of each
document are to be counted are all pairs of a bucket compared, in blocks: that grows with the square of a
family's distinct texts.

Exact copies are collapsed by a 128-bit hash before the signing. Links, components and texts stay
distributed; each round of the component search cuts its lineage with a checkpoint. Aggregates per bucket
combine before the shuffle, and large buckets are joined in blocks, so none has to fit into one task.

Defined results: null texts, and those shorter than ``least_chars`` after trimming, take no part;
texts with fewer words than a shingle are one shingle of all their words; texts without any word are
only like their exact copies. Repeated ids are one document with several texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellore.runtime import broadcast_if_small, checkpoint, stored, strip

WORDS = 5
LEAST = 0.8
COMPONENTS = 200
BLOCK_DOCS = 256
MISS = 1e-3
MOST_BROADCAST = 20_000  # exact copies that are broadcast to be left out; more are joined

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64


def banding(least: float, components: int = COMPONENTS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair of likeness ``least`` no oftener than ``miss``."""
    rows = max((r for r in range(1, components + 1) if (1 - least**r) ** (components // r) <= miss), default=1)
    return components // rows, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Texts to the hashes of their shingles; hashes of words are kept for the next texts."""

    def __init__(self, words: int, most_kept: int = 200_000):
        self.words, self.most_kept, self.kept = words, most_kept, {}

    def _word(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self.kept) >= self.most_kept:
            self.kept.clear()
        self.kept[word] = value
        return value

    def __call__(self, text: str) -> np.ndarray:
        """One hash per shingle, in order of the text, repeats included."""
        kept = self.kept
        found = [kept.get(w) or self._word(w) for w in WORD.findall(text.lower())]
        if not found:
            return np.empty(0, dtype=U64)
        hashes = np.array(found, dtype=U64)
        n = min(self.words, len(hashes))
        out = np.zeros(len(hashes) - n + 1, dtype=U64)
        with np.errstate(over="ignore"):
            for i in range(n):
                out = mix64(out + hashes[i : len(hashes) - n + 1 + i] + U64(0x9E3779B97F4A7C15))
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def probability_likeness(a: np.ndarray, a_weights: np.ndarray, b: np.ndarray, b_weights: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets, both sorted by hash.

    The sum over common x of 1 / sum over y of max(a_y/a_x, b_y/b_x); in the order of a_y/b_y the inner
    sum is a prefix of the b side and a suffix of the a side.
    """
    every = np.union1d(a, b)
    wa, wb = np.zeros(len(every)), np.zeros(len(every))
    wa[np.searchsorted(every, a)] = a_weights
    wb[np.searchsorted(every, b)] = b_weights
    ratio = np.divide(wa, wb, out=np.full(len(every), np.inf), where=wb > 0)
    order = np.argsort(ratio, kind="stable")
    wa, wb = wa[order], wb[order]
    below, above = np.cumsum(wb), wa.sum() - np.cumsum(wa)
    both = (wa > 0) & (wb > 0)
    return float((1 / (above[both] / wa[both] + below[both] / wb[both])).sum())


def prob_min_hash(sets: list[np.ndarray], weights: list[np.ndarray] | None, components: int) -> np.ndarray:
    """The signatures of many weighted sets at once, a row of ``components`` hashes each."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    element = np.concatenate(sets) if count else np.empty(0, dtype=U64)
    rate = np.ones(len(element)) if weights is None else np.concatenate(weights).astype(np.float64)
    first = np.full(count * components, np.inf)
    winner = np.zeros(count * components, dtype=U64)
    time = np.zeros(len(element))
    arrival = 0
    while len(element):
        with np.errstate(over="ignore"):
            random = mix64(element + U64(2 * arrival + 1) * U64(0x9E3779B97F4A7C15))
            place = mix64(random + U64(0xD1B54A32D192ED03)) % U64(components)
        time = time - np.log(((random >> U64(11)).astype(np.float64) + 0.5) / 2**53) / rate
        slot = owner * components + place.astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        winner[slot[won]] = element[won]
        latest = first.reshape(count, components).max(axis=1)
        alive = time < latest[owner]  # a later arrival cannot be the earliest of any component
        owner, element, rate, time = owner[alive], element[alive], rate[alive], time[alive]
        arrival += 1
    return winner.reshape(count, components)


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of each signature in each band."""
    out = np.zeros((len(signatures), bands), dtype=U64) + mix64(np.arange(1, bands + 1, dtype=U64))
    part = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mix64(out + part[:, :, i] + U64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _sign(words: int, weighted: bool, components: int, bands: int, rows: int, block: int = 512):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                found = [np.unique(shingle(t), return_counts=True) for t in part["body"]]
                some = np.array([len(s) > 0 for s, _ in found], dtype=bool)
                found = [f for f in found if len(f[0])]
                signatures = prob_min_hash([s for s, _ in found], [c for _, c in found] if weighted else None, components)
                sketches = signatures.astype(np.uint8)  # the lowest byte of each component
                yield part.loc[some, ["doc"]].assign(buckets=list(bands_of(signatures, bands, rows)), sketch=[x.tobytes() for x in sketches])

    return sign


def least_agreement(least: float, components: int) -> int:
    """In how many bytes two sketches agree at least, by six standard deviations, at a likeness of ``least``."""
    return math.floor(components * least - 6 * math.sqrt(components * least * (1 - least)))


def _likely(least: int):
    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(len(batch), -1) for c in ("sketch_a", "sketch_b"))
                yield batch.loc[(a == b).sum(axis=1) >= least, ["a", "b"]]

    return likely


def _verify(words: int, least: float, weighted: bool):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            sets: dict[str, tuple[np.ndarray, np.ndarray]] = {}

            def of(text: str, sets: dict = sets) -> tuple[np.ndarray, np.ndarray]:
                if text not in sets:
                    sets[text] = np.unique(shingle(text), return_counts=True)
                return sets[text]

            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            pairs = ((of(x), of(y)) for x, y in zip(batch["body_a"], batch["body_b"]))
            how = np.array([probability_likeness(*x, *y) if weighted else likeness(x[0], y[0]) for x, y in pairs])
            ok = how >= least if len(how) else np.empty(0, dtype=bool)
            yield pd.DataFrame({"a": a[ok], "b": b[ok], "likeness": how[ok]})

    return verify


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label for all ends of ``links`` (a, b): the label is the smallest node of the component.

    Each round takes the least label among the neighbours and then the label's own label, so chains
    shrink by at least half.
    """
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("before"))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("further"))
        step = lower.join(jump, "next", "left").select("node", F.least("next", "further").alias("label"), "before")
        step = checkpoint(step)
        labels = step.select("node", "label")
        if step.filter(F.col("label") != F.col("before")).isEmpty():
            return labels
    raise RuntimeError("the component search did not end")


def taking_part(df: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """doc, body and a 128-bit hash of the body, of the texts long enough."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("body"))
    rows = rows.filter(F.col("doc").isNotNull() & (F.length("body") >= least_chars) & (F.length(strip(F.col("body"))) >= least_chars))
    return rows.select("doc", "body", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"))


def duplicate_groups(df: DataFrame, id_col: str = "page_id", text_col: str = "body_md", words: int = WORDS, least: float = LEAST, least_chars: int = 0, weighted: bool = False, components_count: int = COMPONENTS, count_links: bool = True) -> DataFrame:
    """One row per document taking part: page_id, group_id (the group's smallest id), links.

    ``links`` counts the verified links of the document's text to other texts; documents without any
    likeness are groups of their own. For the count every pair of a bucket is verified. Without
    ``count_links`` the column is missing and only pairs that may join groups are verified.
    """
    bands, rows = banding(least, components_count)
    texts = taking_part(df, id_col, text_col, least_chars)
    members = checkpoint(texts.select("doc", "h1", "h2"))
    of_copies = members.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("copies"))
    copies = checkpoint(members.join(of_copies.filter("copies > 1"), ["h1", "h2"]).filter("doc <> first").select("doc", "h1", "h2"))
    distinct = texts.join(broadcast_if_small(copies, MOST_BROADCAST), ["doc", "h1", "h2"], "left_anti").select("doc", "body")
    signed = stored(distinct.mapInPandas(_sign(words, weighted, components_count, bands, rows), "doc bigint, buckets array<bigint>, sketch binary"), "signatures")
    banded = signed.select("doc", F.explode("buckets").alias("bucket"))
    met = banded.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.max("doc").alias("top")).filter("pivot <> top").select("bucket", "pivot")
    shared = checkpoint(banded.join(met, "bucket"))
    agreement = least_agreement(least, components_count)

    def verified(pairs: DataFrame) -> DataFrame:
        sketch = lambda side: signed.select(F.col("doc").alias(side), F.col("sketch").alias(f"sketch_{side}"))
        likely = pairs.join(sketch("a"), "a").join(sketch("b"), "b").mapInPandas(_likely(agreement), "a bigint, b bigint")
        bodies = distinct.select("doc", "body")
        left = likely.join(bodies.select(F.col("doc").alias("b"), F.col("body").alias("body_b")), "b")
        whole = left.join(bodies.select(F.col("doc").alias("a"), F.col("body").alias("body_a")), "a")
        return checkpoint(whole.select("a", "b", "body_a", "body_b").mapInPandas(_verify(words, least, weighted), "a bigint, b bigint, likeness double"))

    def grouped(labels: DataFrame) -> DataFrame:
        found = members.join(of_copies, ["h1", "h2"]).join(labels.withColumnRenamed("node", "first"), "first", "left")
        return found.select("first", F.col("doc").alias("page_id"), F.coalesce("label", "first").alias("group_id"))

    if count_links:
        links = verified(_bucket_pairs(shared))
        degree = links.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("links"))
        return grouped(components(links)).join(degree, "first", "left").select("page_id", "group_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links")).distinct()
    tested = shared.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    links = verified(tested)
    labels = components(links)
    late = verified(_pairs_apart(shared, labels).join(tested, ["a", "b"], "left_anti"))
    if not late.isEmpty():
        labels = components(links.unionByName(late))
    return grouped(labels).drop("first").distinct()


def _in_blocks(shared: DataFrame, left: DataFrame) -> DataFrame:
    """``left`` (bucket, a, ...) joined with all members (bucket, b, ...) of the same bucket; large buckets are spread over blocks."""
    blocks = shared.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks"))
    right = shared.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).drop("blocks")
    spread = left.join(blocks, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return spread.join(right, ["bucket", "block"])


def _bucket_pairs(shared: DataFrame) -> DataFrame:
    """All distinct pairs a < b of documents with a common bucket."""
    return _in_blocks(shared.select("bucket", F.col("doc").alias("b")), shared.select("bucket", F.col("doc").alias("a"))).filter("a < b").select("a", "b").distinct()


def _pairs_apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct pairs a < b of documents with a common bucket but different labels.

    One of the two is no member of the bucket's most frequent label, so only those outsiders are joined with all.
    """
    labelled = shared.select("bucket", "doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    counts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("bucket", F.col("most.label").alias("main"))
    apart = labelled.join(mixed, "bucket")
    outside = apart.filter("label <> main").select("bucket", F.col("doc").alias("a"), F.col("label").alias("label_a"))
    met = _in_blocks(apart.select("bucket", F.col("doc").alias("b"), F.col("label").alias("label_b")), outside).filter("label_a <> label_b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of members a < b of each group."""
    big = groups.select("group_id", "page_id")
    other = big.select("group_id", F.col("page_id").alias("page_id_b"))
    return big.join(other, "group_id").filter("page_id < page_id_b").select(F.col("page_id").alias("page_id_a"), "page_id_b")
