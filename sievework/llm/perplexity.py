"""Quality rules: plain statistics of words and lines, and bands of n-gram perplexity.

The language model is a modified Kneser-Ney model over bytes, one a language
(``lang``; a null one is the language ''), counted by Spark over every byte of
all documents. A text is read with ``ORDER - 1`` zero bytes in front. The
highest order counts occurrences, the lower ones distinct bytes to the left;
each order's three discounts come from its counts of counts (0.5, 1 and 1.5
where those are too few to tell), and the interpolated probabilities are held
as whole costs, -ln(p) in 65,536ths rounded down. Costs are added as whole
numbers, so a document's perplexity doesn't hang on any order of rows.

The model's n-grams are kept in arrays sorted by hash, reached by the top bits.
It grows with the corpus: up to ``BROADCAST_GRAMS`` n-grams it is broadcast;
beyond, documents' distinct n-grams are shuffled and joined with the counted
tables, order by order, with the same result. A byte n-gram of an order that
the model has not seen falls back to the next lower order, at the cost of its
context's weight, and at last to 1 in 256.

Bands: a document's deviation is its mean cost a byte less its language's median,
times the root of n / (n + ``EVEN_AT``) for n bytes, as the means of short texts
scatter more. Over all documents of a language that pass the plain rules, the
quartiles of the deviations are taken; a document is kept while its own lies
within ``SPREAD`` times their distance (``LEAST_SPREAD`` at least) below the
lower and above the upper one. The lower band takes texts that the model finds
too easy (the same words or signs over and over), the upper one those that look
like no other of their language. Both settings were chosen on two of five folds
of labelled documents (README, with figures of the others); labels play no part
in the operator.

Null and empty texts have no words and fail the plain rules, so they aren't
kept. Rows that repeat are counted and judged each; ties don't matter, as rows
are judged alone. Very long texts are a slice of their own. A language that no
other document has is its own model and its own band. An empty table gives no
rows. Extra columns, whatever their names, are not read; ``kept_documents``
keeps them. Without a column ``lang`` all documents are one language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .common import cut, fresh, joined, mapped

ORDER = 5
#: Parts that a natural-log unit of cost has.
UNIT = 65_536
LEAST_WORDS, MOST_REPEATED = 50, 50
SPREAD, LEAST_SPREAD, EVEN_AT = 2.5, UNIT // 64, 1_500
#: N-grams that may be broadcast, 12 bytes each.
BROADCAST_GRAMS = 6_000_000
#: Distinct n-grams that a counting task holds before it hands them on.
HELD_GRAMS = 2_000_000
BROADCAST_LANGUAGES = 10_000
SALTS = 16
_FALLBACK = (0.5, 1.0, 1.5)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _packed(part: tb.Slice, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte's n-gram as a number (the oldest byte highest), text by text, and the end of each text's."""
    size = np.diff(part.offsets)
    ends = np.cumsum(size)
    pad = order - 1
    wide = np.zeros(len(part.raw) + pad * part.n, np.uint64)
    at = np.arange(len(part.raw)) + pad * (1 + np.repeat(np.arange(part.n), size))
    wide[at] = part.raw
    gram = np.zeros(len(part.raw), np.uint64)
    for back in range(pad, -1, -1):
        gram = (gram << np.uint64(8)) | wide[at - back]
    return gram, ends


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))


def _count(order: int):
    """(lang, gram, n) of a task's texts, added up as far as ``HELD_GRAMS`` goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh_ones: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def fold() -> None:
            for lang, some in fresh_ones.items():
                if lang in held:
                    some.append(held[lang])
                gram, n = np.concatenate([g for g, _ in some]), np.concatenate([c for _, c in some])
                by = np.argsort(gram)
                gram, n = gram[by], n[by]
                first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                held[lang] = gram[first], np.add.reduceat(n, first)
            fresh_ones.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (gram, n) in held.items():
                for lo in range(0, len(gram), 50_000):
                    g, c = gram[lo : lo + 50_000], n[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(tb.signed(g)), pa.array(c)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part in tb.parts(batch.column(1), fold=tb.AS_IT_IS):
                gram, ends = _packed(part, order)
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, some in zip(langs[part.at : part.at + part.n], np.split(gram, ends[:-1]), strict=True):
                    by_lang.setdefault(lang, []).append(some)
                for lang, several in by_lang.items():
                    some = np.sort(np.concatenate(several))
                    if len(some):
                        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
                        fresh_ones.setdefault(lang, []).append((some[first], np.diff(np.append(first, len(some)))))
                        waiting += len(first)
            if waiting > HELD_GRAMS:
                fold()
                waiting = 0
                if sum(len(g) for g, _ in held.values()) > HELD_GRAMS:
                    yield from out()
        fold()
        yield from out()

    return run


def _suffix(gram: Column, k: int) -> Column:
    """The last k bytes."""
    return gram.bitwiseAND(F.lit((1 << 8 * k) - 1))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    tallies = {r.n: r.many for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("many")).collect()}  # four rows at most
    t1, t2, t3, t4 = (tallies.get(k, 0) for k in (1, 2, 3, 4))
    if not (t1 and t2 and t3):
        return _FALLBACK
    y = t1 / (t1 + 2 * t2)
    found = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3)
    return tuple(d if 0 < d < k else f for d, k, f in zip(found, (1, 2, 3), _FALLBACK, strict=True))


class Model:
    """The counted tables: ``grams[k]`` has lang, gram, cost of order k + 1, ``weights[k]`` lang, gram, cost of contexts of k bytes."""

    def __init__(self, docs: DataFrame, order: int = ORDER):
        if not 1 <= order <= 7:
            raise ValueError("an order from 1 to 7")
        self.order, self.spark = order, docs.sparkSession
        found = mapped(_texts(docs).select("lang", "text"), _count(order), "lang string, gram long, n long")
        counts = {order: cut(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")))}
        for k in range(order - 1, 0, -1):
            counts[k] = cut(counts[k + 1].groupBy("lang", _suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")))
        self.grams, self.weights, below = [], [], None
        for k in range(1, order + 1):
            d1, d2, d3 = _discounts(counts[k])
            context = F.shiftright("gram", 8).alias("context")
            off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            of = counts[k].groupBy("lang", context).agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") > 2).alias("n3"))
            of = of.select("lang", "context", "total", ((d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")).alias("rest"))
            rows = counts[k].withColumns({"context": F.shiftright("gram", 8), "off": off}).join(of, ["lang", "context"])
            if below is None:
                rows = rows.withColumn("lower", F.lit(1 / 256))
            else:
                rows = rows.withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
            below = cut(rows.select("lang", "gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("rest") * F.col("lower")).alias("p")))
            whole = lambda p: F.floor(-F.log(p) * UNIT).cast("int").alias("cost")
            self.grams.append(below.select("lang", "gram", whole(F.col("p"))))
            self.weights.append(of.select("lang", F.col("context").alias("gram"), whole(F.col("rest"))))
        self.size = sum(g.count() for g in self.grams)

    def arrays(self) -> Arrays:
        """For a model of a checked size: the tables on the driver, in arrays sorted by hash."""
        return Arrays(self.order, [g.toArrow() for g in self.grams], [w.toArrow() for w in self.weights])


def seed_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


class Sorted:
    """Costs by 64-bit key: keys ascend, the top bits of a key say where to begin."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.costs = keys[by], costs[by].astype(np.int32)
        self.bits = max(1, int(len(keys)).bit_length())
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.begin = np.searchsorted(self.keys, edges).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The cost of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        at = self.begin[(keys >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            inside = at < len(self.keys)
            open_, at = open_[inside], at[inside]
            here, want = self.keys[at], keys[open_]
            same = here == want
            out[open_[same]] = self.costs[at[same]]
            on = here < want
            open_, at = open_[on], at[on] + 1
        return out


class Arrays:
    """A model in memory: for each order the n-grams' costs and the contexts' weights, keyed by a hash of language and bytes."""

    def __init__(self, order: int, grams: list[pa.Table], weights: list[pa.Table]):
        self.order = order
        self.grams, self.weights = [self._sorted(t) for t in grams], [self._sorted(t) for t in weights]

    @staticmethod
    def _sorted(t: pa.Table) -> Sorted:
        lang = t["lang"].combine_chunks().dictionary_encode()
        names = lang.dictionary.to_pylist()
        seeds = np.array([seed_of(x) for x in names] or [0], np.uint64)
        gram = tb.unsigned(t["gram"].to_numpy())
        return Sorted(tb.mix(gram + seeds[lang.indices.to_numpy(zero_copy_only=False)]) if len(gram) else gram, t["cost"].to_numpy())

    def costs(self, gram: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """The cost of each n-gram (of the full order) in the language of its seed."""
        out, open_ = np.zeros(len(gram), np.int64), np.arange(len(gram))
        for k in range(self.order, 0, -1):
            g = gram[open_] & np.uint64((1 << 8 * k) - 1)
            found = self.grams[k - 1].find(tb.mix(g + seed[open_]))
            hit = found >= 0
            out[open_[hit]] += found[hit]
            open_, g = open_[~hit], g[~hit]
            if not len(open_):
                return out
            weight = self.weights[k - 1].find(tb.mix((g >> np.uint64(8)) + seed[open_]))
            out[open_] += np.maximum(weight, 0)
        out[open_] += int(np.log(256) * UNIT)
        return out


def rules(part: tb.Slice) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a slice that is as it is."""
    part.words(tb.NOT_SPACE)
    h, w, starts, ends = part.hashes(), part.w, part.starts, part.ends
    n, of_word = np.diff(w), np.repeat(np.arange(part.n), np.diff(w))
    chars = np.concatenate([[0], np.cumsum((part.buf & 0xC0) != 0x80)])
    word_chars = np.bincount(of_word, (chars[ends] - chars[starts]), part.n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[part.buf])])
    n_symbols = symbols[part.last] - symbols[part.first]

    def again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key came before, and whether it comes more than once."""
        _, first, back, many = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        earlier = np.ones(len(key), bool)
        earlier[first] = False
        return earlier, many[back] > 1

    repeated = np.zeros(len(h) + 1, np.int32)
    if len(h) >= 3:
        inside = of_word[:-2] == of_word[2:]
        window = tb.mix(tb.mix(tb.mix(h[:-2]) + h[1:-1]) + h[2:] + tb.mix(of_word[2:].astype(np.uint64)))[inside]
        at = np.flatnonzero(inside)[again(window)[1]]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + 3, -1)
    n_repeat = np.bincount(of_word[np.cumsum(repeated[:-1]) > 0], minlength=part.n)
    part.words(_LINE)
    lines, a, b, lw = part.hashes(), part.starts, part.ends, part.w
    of_line = np.repeat(np.arange(part.n), np.diff(lw))
    with_word = np.searchsorted(starts, a) < np.searchsorted(starts, b)
    key = tb.mix(lines + tb.mix(of_line.astype(np.uint64)))[with_word]
    n_dup = np.bincount(of_line[with_word][again(key)[0]], minlength=part.n)
    return np.stack([n, word_chars, n_symbols, n_dup, n_repeat], axis=1).astype(np.int64)


_COLUMNS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long"


def _judged(batch: pa.RecordBatch, part: tb.Slice, found: np.ndarray) -> list[pa.Array]:
    return [batch.column(0).slice(part.at, part.n), batch.column(1).slice(part.at, part.n), *(pa.array(c) for c in found.T), pa.array(np.diff(part.offsets))]


def _scored(model):
    """``_COLUMNS`` and cost, by a broadcast model."""
    names = [c.split()[0] for c in _COLUMNS.split(", ")] + ["cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, seeds = model.value, {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for part in tb.parts(batch.column(2), fold=tb.AS_IT_IS):
                gram, ends = _packed(part, arrays.order)
                own = [seeds.setdefault(x, seed_of(x)) for x in langs[part.at : part.at + part.n]]
                size = np.diff(ends, prepend=0)
                costs = np.concatenate([[0], np.cumsum(arrays.costs(gram, np.repeat(np.array(own, np.uint64), size)))])
                yield pa.RecordBatch.from_arrays([*_judged(batch, part, rules(part)), pa.array(costs[ends] - costs[ends - size])], names=names)

    return run


def _with_grams(order: int):
    """``_COLUMNS``, and each text's distinct n-grams with their numbers."""
    names = [c.split()[0] for c in _COLUMNS.split(", ")] + ["grams", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.parts(batch.column(2), fold=tb.AS_IT_IS):
                gram, ends = _packed(part, order)
                own = [np.unique(x, return_counts=True) for x in np.split(gram, ends[:-1])]
                lists = [pa.array([tb.signed(g) for g, _ in own], pa.list_(pa.int64())), pa.array([n for _, n in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*_judged(batch, part, rules(part)), *lists], names=names)

    return run


def _by_join(texts: DataFrame, model: Model) -> DataFrame:
    """``_COLUMNS`` and cost, by joins of the documents' distinct n-grams with the model's tables."""
    every = cut(mapped(texts, _with_grams(model.order), f"{_COLUMNS}, grams array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()))
    open_ = every.select("row", "lang", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", "lang", F.col("x.grams").alias("gram"), F.col("x.times").alias("n"), F.lit(0).cast("long").alias("paid"))
    salt, sums = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"), []

    def looked_up(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
        """A common n-gram's rows go to several tasks."""
        spread = table.withColumnRenamed("cost", name).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", salt).join(spread, ["lang", "gram", "salt"], "left").drop("salt")

    for k in range(model.order, 0, -1):
        rows = cut(looked_up(open_.withColumn("gram", _suffix(F.col("gram"), k)), model.grams[k - 1], "cost"))
        sums.append(rows.filter("cost is not null").groupBy("row").agg(F.sum(F.expr("n * (paid + cost)")).alias("cost")))
        rest = rows.filter("cost is null").select("row", "lang", F.col("gram").alias("whole"), F.shiftright("gram", 8).alias("gram"), "n", "paid")
        open_ = looked_up(rest, model.weights[k - 1], "weight").select("row", "lang", F.col("whole").alias("gram"), "n", (F.col("paid") + F.coalesce("weight", F.lit(0))).alias("paid"))
    sums.append(open_.groupBy("row").agg(F.sum(F.col("n") * (F.col("paid") + int(np.log(256) * UNIT))).alias("cost")))
    total = sums[0]
    for more in sums[1:]:
        total = total.unionByName(more)
    total = total.groupBy("row").agg(F.sum("cost").alias("cost"))
    return every.drop("grams", "times").join(total, "row", "left").withColumn("cost", F.coalesce("cost", F.lit(0).cast("long"))).drop("row")


def scores(docs: DataFrame, model: Model, broadcast_grams: int | None = None) -> DataFrame:
    """doc_id, lang, the plain statistics, n_bytes and cost (in ``UNIT``\\ ths, over all bytes) of each row of ``docs``."""
    texts = _texts(docs)
    if model.size <= (BROADCAST_GRAMS if broadcast_grams is None else broadcast_grams):
        return mapped(texts, _scored(docs.sparkSession.sparkContext.broadcast(model.arrays())), f"{_COLUMNS}, cost long")
    return _by_join(texts, model)


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _evened(n: Column) -> Column:
    return F.sqrt(n / (n + EVEN_AT))


def _deviation() -> Column:
    return F.round((F.expr("cost div nullif(n_bytes, 0)") - F.col("centre")) * _evened(F.col("n_bytes"))).cast("long")


def bands(scored: DataFrame, spread: float = SPREAD, least: int = LEAST_SPREAD) -> DataFrame:
    """lang, centre, low, high: a row a language, from its documents that pass the plain rules; low and high bound deviations from the centre."""
    good = scored.filter(~_failed())
    quartile = lambda c, at: F.expr(f"percentile({c}, array({at}), many)")  # noqa: E731  # exact, over values that are counted first
    means = good.groupBy("lang", F.expr("cost div nullif(n_bytes, 0)").alias("mean")).agg(F.count("*").alias("many"))
    centres = cut(means.groupBy("lang").agg(quartile("mean", "0.5D").alias("q")).select("lang", F.col("q")[0].alias("centre")))
    off = joined(good, centres, "lang", BROADCAST_LANGUAGES).groupBy("lang", "centre", _deviation().alias("off")).agg(F.count("*").alias("many"))
    wide = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(float(least))) * spread
    return off.groupBy("lang", "centre").agg(quartile("off", "0.25D, 0.75D").alias("q")).select("lang", "centre", (F.col("q")[0] - wide).alias("low"), (F.col("q")[1] + wide).alias("high"))


def quality_rules(docs: DataFrame, spread: float = SPREAD, order: int = ORDER, broadcast_grams: int | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, perplexity (a byte), low, high (the band's ends for a text as long, as perplexities) of each row of ``docs``."""
    scored = cut(scores(docs, Model(docs, order), broadcast_grams))
    rows = joined(scored, cut(bands(scored, spread)), "lang", BROADCAST_LANGUAGES).withColumn("off", _deviation())
    mean = F.expr("cost div nullif(n_bytes, 0)")
    as_perplexity = lambda c: F.exp(c / UNIT)
    end = lambda c: as_perplexity(F.col("centre") + F.try_divide(F.col(c), _evened(F.col("n_bytes")))).alias(c)
    kept = ~_failed() & F.coalesce(F.col("off").between(F.col("low"), F.col("high")), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"), kept.alias("kept"), "lang", as_perplexity(mean).alias("perplexity"), end("low"), end("high"))


def kept_documents(docs: DataFrame, spread: float = SPREAD, order: int = ORDER) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. The rows are written once, so that their numbers hold."""
    row = fresh(docs, "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    lang = [F.col("lang")] if "lang" in docs.columns else []
    judged = quality_rules(numbered.select(F.col(row).alias("doc_id"), "text", *lang), spread, order)
    return numbered.join(judged.filter("kept").select(F.col("doc_id").alias(row)), row, "left_semi").drop(row)
