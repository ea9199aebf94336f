"""Toxicity by nearest labelled examples under exact cosine of label-weighted TF-IDF.

Terms are words (A-Z lower-cased) and the first five bytes of longer words. All
terms of the labelled examples count that are in two of them at least and in
``MOST_SHARE`` of them at most (a document frequency, whatever the label). A
term's weight is its logarithmic frequency in the text, times its inverse
document frequency over all documents, times how far its examples' labels lean
from chance in either direction (standard deviations, to a power). That last
factor isn't part of plain TF-IDF: without it most toxic documents are missed
(README, with figures), as one rude word weighs little among hundreds of others.
Labelled examples form an inverted index in blocks, with the largest weight of
each term in each block where it occurs. For a document, blocks are opened in
order of their upper bound until no further block can reach the k-th best
similarity, so the k nearest are exact. Their votes, weighted by squared
similarity, and the share of toxic examples as prior give the score.

``FIT_EXAMPLES`` labelled documents (those of smallest id hash) are used at
most, each once however often it repeats; of an id's several labels the larger
counts, of its several texts the smallest. Labels of the held-out fold never
count. An example has no vote on the document that it is: a row with an example's
id leaves that example out, so its own label is no input of its score. Copies of
an example under another id are documents of their own, for which it does vote.

Null and empty texts hold no term and get the prior. A very long text is a slice
of its own. Of equally near examples the earlier in the index votes. If no
labels exist, every score is 0; if all are of one kind, it is that kind's share.
Rows that repeat are scored each; an empty table gives no rows. Extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .common import cut, fold_of, mapped

FOLDS, HELD_OUT = 4, 2
FIT_EXAMPLES = 8_000
LEAST_DF, MOST_SHARE = 2, 0.05
NEIGHBOURS, BLOCK = 30, 64
THRESHOLD = 0.3
PRIOR_WEIGHT = 0.25
_PREFIX = 5
#: Texts whose votes a task remembers, some 400 bytes each whatever their length.
REMEMBERED = 50_000
#: Blocks that are opened at first, for a k-th best that others must reach.
_OPENED = 4


def _terms(part: tb.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every word and prefix of the slice's texts."""
    part.words(tb.ALNUM)
    h = part.hashes()
    text = np.repeat(np.arange(part.n), np.diff(part.w))
    longer = np.flatnonzero(part.ends - part.starts > _PREFIX)
    x = np.full(len(longer), 0x5052, np.uint64)
    for k in range(_PREFIX):
        x = (x << np.uint64(8)) | part.buf[part.starts[longer] + k]
    return np.concatenate([text, text[longer]]), np.concatenate([h, tb.mix(x)])


def _term_counts(batches):
    """term, documents with it, toxic documents with it; from (label, text)."""
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        terms, toxic = [], []
        for part in tb.parts(batch.column(1)):
            text, term = _terms(part)
            order = np.lexsort((term, text))
            text, term = text[order], term[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
            terms.append(term[new]), toxic.append(label[part.at + text[new]])
        if not terms:
            continue
        distinct, back = np.unique(np.concatenate(terms), return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tb.signed(distinct)), pa.array(np.bincount(back).astype(np.int64)), pa.array(np.bincount(back, np.concatenate(toxic)).astype(np.int64))],
            names=["term", "n", "toxic"],
        )


class Lookup:
    """Maps terms to vocabulary numbers; most other terms fail a bit test first."""

    def __init__(self, vocabulary: np.ndarray):
        self.terms, self.gate = np.sort(vocabulary), None

    def counts(self, part: tb.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, vocabulary number, count), ascending."""
        if self.gate is None:
            self.gate = np.zeros(1 << 22, bool)
            self.gate[(self.terms >> np.uint64(42)).astype(np.int64)] = True
        text, term = _terms(part)
        maybe = np.flatnonzero(self.gate[(term >> np.uint64(42)).astype(np.int64)])
        text, term = text[maybe], term[maybe]
        at = np.searchsorted(self.terms, term)
        ok = at < len(self.terms)
        ok[ok] = self.terms[at[ok]] == term[ok]
        pair, many = np.unique(text[ok].astype(np.int64) * len(self.terms) + at[ok], return_counts=True)
        return pair // max(1, len(self.terms)), pair % max(1, len(self.terms)), many


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo:hi, one after the other."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Index:
    """Examples as unit vectors in postings by term and block of examples, with the largest weight of each such list.

    ``start``, ``term``, ``weight``: example i's terms and weights, in ``start[i]:start[i + 1]``.
    """

    def __init__(self, start: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, ids: np.ndarray, terms: int, prior: float):
        n = len(ids)
        # like examples side by side, so that a block's maxima are tight
        lead = np.array([term[a + np.argmax(weight[a:b])] if b > a else -1 for a, b in zip(start[:-1], start[1:], strict=True)], np.int64)
        order = np.lexsort((ids, lead))
        self.labels, self.ids, self.prior, self.blocks = labels[order].astype(float), ids[order], prior, -(-n // BLOCK)
        size = np.diff(start)[order]
        at, where = np.repeat(np.arange(n), size), _ranges(start[:-1][order], start[1:][order])
        by = np.lexsort((at, term[where]))
        self.at, self.weight = at[by].astype(np.int32), weight[where][by]
        key = term[where][by] * (self.blocks + 1) + self.at // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        #: List j holds the postings list[j]:list[j + 1], all of block block[j]; term t's lists are of[t]:of[t + 1].
        self.list = np.concatenate([first, [len(key)]])
        self.block = (key[first] % (self.blocks + 1)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(key) else np.empty(0, weight.dtype)
        self.of = np.searchsorted(key[first] // (self.blocks + 1), np.arange(terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(example, similarity) of the k most similar examples of similarity above 0, ties to the earlier example."""
        lo, hi = self.of[terms], self.of[terms + 1]
        lists, w = _ranges(lo, hi), np.repeat(weights, hi - lo)
        bound = np.bincount(self.block[lists], w * self.most[lists], self.blocks)
        rank = np.empty(self.blocks, np.int64)
        rank[np.argsort(-bound, kind="stable")] = np.arange(self.blocks)
        place = rank[self.block[lists]]
        sims, who, worst, done = np.empty(0), np.empty(0, np.int64), 0.0, 0
        for upto in (_OPENED, int((bound > 0).sum())):  # some blocks for a first k-th best, then those that can still reach it
            if done and len(sims) == k:
                upto = int((bound >= worst - 1e-12).sum())
            mine = np.flatnonzero((place >= done) & (place < upto))
            if not len(mine):
                continue
            a, b = self.list[lists[mine]], self.list[lists[mine] + 1]
            posts = _ranges(a, b)
            score = np.bincount(self.at[posts], np.repeat(w[mine], b - a) * self.weight[posts], len(self.ids))
            near = np.flatnonzero(score > max(0.0, worst - 1e-12))
            sims, who = np.concatenate([sims, score[near]]), np.concatenate([who, near])
            best = np.lexsort((who, -sims))[:k]
            sims, who, done = sims[best], who[best], upto
            worst = sims[-1] if len(sims) == k else 0.0
        return who, sims

    def vote(self, terms: np.ndarray, weights: np.ndarray, but: int | None = None) -> tuple[float, list[int]]:
        """Score, and the ids of the three nearest; the example of id ``but`` has no vote."""
        if not len(terms) or not self.blocks:
            return self.prior, []
        if but is None:
            who, sims = self.nearest(terms, weights)
        else:
            who, sims = self.nearest(terms, weights, NEIGHBOURS + 1)
            others = self.ids[who] != but
            who, sims = who[others][:NEIGHBOURS], sims[others][:NEIGHBOURS]
        w = sims**2
        return float((w @ self.labels[who] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT)), [int(i) for i in self.ids[who[:3]]]


class Model:
    def __init__(self, lookup: Lookup, factor: np.ndarray):
        self.lookup, self.factor, self.index = lookup, factor, None

    def vectors(self, part: tb.Slice):
        """For each text: its terms and unit weights."""
        text, term, many = self.lookup.counts(part)
        weight = (1 + np.log(many)) * self.factor[term]
        some = weight > 0
        text, term, weight = text[some], term[some], weight[some]
        cuts = np.searchsorted(text, np.arange(part.n + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            w = weight[a:b]
            yield term[a:b], w / np.sqrt(w @ w) if b > a else w


def _frequencies(lookup):
    """(term, texts that hold it) of a task's texts, and their number as term -1."""

    def run(batches):
        held = lookup.value
        n, df = 0, np.zeros(len(held.terms), np.int64)
        for batch in batches:
            n += batch.num_rows
            for part in tb.parts(batch.column(0)):
                df += np.bincount(held.counts(part)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[n], df[some]]))], names=["term", "df"])

    return run


def _score(model):
    def run(batches):
        m, memo, known = model.value, {}, set(model.value.index.ids.tolist())
        for batch in batches:
            score, evidence, doc_id = [], [], batch.column(0).to_pylist()
            for part in tb.parts(batch.column(2)):
                for i, (terms, weights) in enumerate(m.vectors(part), part.at):
                    own = doc_id[i] if doc_id[i] in known else None
                    key = (own, hashlib.blake2b(terms.tobytes() + weights.tobytes(), digest_size=16).digest())
                    got = memo.get(key)
                    if got is None:
                        got = m.index.vote(terms, weights, own)
                        if len(memo) < REMEMBERED:
                            memo[key] = got
                    score.append(got[0]), evidence.append(got[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    return run


def _leaning(n: np.ndarray, toxic: np.ndarray, examples: float, bad: float) -> np.ndarray:
    """How many standard deviations a term's share of toxic examples lies from chance, in either direction, to the power 1.5."""
    share = bad / examples
    return (np.abs(toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share) * (1 - n / examples), 1e-12))) ** 1.5


def fit(docs: DataFrame, labels: DataFrame, examples: int = FIT_EXAMPLES) -> Model:
    """Terms, document frequencies and index from the labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    rows = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = cut(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    n, bad = (float(x or 0) for x in train.agg(F.count("*"), F.sum("toxic")).first())
    terms, factor = np.empty(0, np.uint64), np.empty(0)
    if 0 < bad < n:
        counted = mapped(train.select("toxic", "text"), _term_counts, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("a"))
        got = counted.filter(F.col("n").between(LEAST_DF, max(10, int(MOST_SHARE * n)))).toArrow()  # the terms of the examples, a bounded number of texts
        terms = tb.unsigned(got["term"].to_numpy())
        order = np.argsort(terms)
        terms, factor = terms[order], _leaning(got["n"].to_numpy()[order].astype(float), got["a"].to_numpy()[order].astype(float), n, bad)
        df, total = np.zeros(len(terms)), 0
        counted = mapped(docs.select(F.col("text").cast("string")), _frequencies(spark.sparkContext.broadcast(Lookup(terms))), "term long, df long")
        counted = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term
        at, many = counted["term"].to_numpy(), counted["df"].to_numpy()
        df[at[at >= 0]], total = many[at >= 0], int(many[at < 0].sum())
        factor = factor * (1 + np.log((total + 1) / (df + 1)))
    model = Model(Lookup(terms), factor)
    held = spark.sparkContext.broadcast(model)

    def vectors(batches):
        for batch in batches:
            rows = [x for part in tb.parts(batch.column(2)) for x in held.value.vectors(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _ in rows], pa.list_(pa.int64())), pa.array([w.astype(np.float32) for _, w in rows], pa.list_(pa.float32()))],
                names=["doc_id", "toxic", "terms", "weights"],
            )

    got = mapped(train, vectors, "doc_id long, toxic int, terms array<long>, weights array<float>").toArrow().combine_chunks()  # as many rows as examples
    size = pa.compute.list_value_length(got["terms"]).to_numpy()
    flat = lambda c, kind: pa.compute.list_flatten(got[c]).to_numpy().astype(kind)
    model.index = Index(
        np.concatenate([[0], np.cumsum(size)]).astype(np.int64), flat("terms", np.int64), flat("weights", np.float32), got["toxic"].to_numpy(), got["doc_id"].to_numpy(), len(terms), bad / n if n else 0.0
    )
    return model


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = FIT_EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, examples))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id").cast("long"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    return mapped(rows, _score(model), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
