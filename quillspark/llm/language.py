"""Language ID by prediction by partial matching: per language a byte context tree, frozen after counting.

A tree holds, for every context of 0 to ``ORDER`` bytes, how often each byte followed. The code length of a
byte is that of the longest context that has seen it, after the escapes of the longer ones (method C: a
context with T bytes seen of D kinds gives a byte seen n times n / (T + D), and the escape D / (T + D));
beyond order 0 every byte has 1/256. Symbols of longer contexts are not excluded again after an escape.
Frozen counts make a byte's code length a function of it and its ORDER predecessors, so the length of each kind of
gram in a stretch of text is worked out once, and a text's length is the sum over its positions. The language with
the shortest code wins. Lengths are kept for the pairs of gram and language that were seen, and escapes for those of
context and language.

Texts are lower-cased; a text begins as if after ORDER line breaks.

Defined results: a null text and one without a letter are ``und`` with score 0; null languages teach
nothing, nor do those with fewer than ``least`` different documents; with no language to learn everything is ``und``; ties go to the first language by name; very long
texts are scored whole, a chunk at a time; repeated rows, equal and null ids each get a row, and teach by what they say; an empty table
gives an empty result; other columns, of any name, are ignored by ``predict`` and kept by ``accepted``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, held_out, pieces, prepare, release, texts

ORDER = 3
GRAM = ORDER + 1
CHUNK = 1 << 20


def _grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with their predecessors as 32-bit numbers, and where each text begins."""
    pad = b"\n" * ORDER
    joined = np.frombuffer(pad.join([b"", *raws]) if raws else b"", np.uint8)
    sizes = np.array([len(x) for x in raws], np.int64)
    starts = np.cumsum(sizes + ORDER) - sizes  # of each text's own bytes
    grams = np.zeros(len(joined), np.uint32)
    for back in range(GRAM):
        grams[back:] |= joined[: len(joined) - back].astype(np.uint32) << np.uint32(8 * back)
    own = np.ones(len(joined), bool)
    for i in range(ORDER):
        own[starts - 1 - i] = False
    return grams[own], np.cumsum(sizes) - sizes


def _count(batches):
    """(lang, gram, n) of each batch."""
    for batch in pieces(batches):
        langs = np.array(batch.column(0).to_pylist(), object)
        raws = [x.lower().encode() for x in texts(batch)]
        for lang in sorted(set(langs)):
            grams, _ = _grams([r for r, own in zip(raws, langs == lang) if own])
            kinds, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def sample(rows: DataFrame, label: str, size: int, *keys: str) -> DataFrame:
    """At most ``size`` different rows of each label (all, where there are fewer): those with the lowest hash of ``keys``. The only rows a model sees.

    Rows with equal keys are one row, and one of them stays; so with an id and a text as keys, neither equal ids nor a row
    that a third of the table repeats let in more. A null key is a value like any other.
    """
    (tag,) = free(rows, "tag")
    tagged = rows.withColumn(tag, F.xxhash64(F.lit("sample"), *(F.struct(F.col(k).isNull(), F.col(k)) for k in keys)))
    different = tagged.select(label, tag).distinct()
    n, r = free(different, "n", "r")
    counted = different.join(different.groupBy(label).agg(F.count("*").alias(n)), label)
    # By chance some more than ``size`` have a hash below that share; the rank takes those away.
    share = (F.col(tag).cast("double") / 2.0**64 + 0.5) * F.col(n)
    few = counted.where(share < size + 6 * size**0.5 + 10)
    chosen = few.withColumn(r, F.row_number().over(Window.partitionBy(label).orderBy(tag))).where(F.col(r) <= size).select(label, tag)
    return tagged.join(F.broadcast(chosen), [label, tag], "left_semi").dropDuplicates([label, tag]).select(*rows.columns)


#: Code lengths are worked out for so many grams times languages at a time.
CELLS = 1 << 22


class Table:
    """Numbers by (key, language), sorted, for the pairs that have one."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, values: np.ndarray):
        """keys and langs sorted together."""
        self.keys, starts = np.unique(keys, return_index=True)
        self.starts = np.append(starts, len(keys))
        self.langs, self.values = langs.astype(np.int32), values.astype(np.float32)

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``keys``, language, number) of every number that one of the keys has."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        here = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.zeros(0, np.int64)
        first, n = self.starts[at[here]], self.starts[at[here] + 1] - self.starts[at[here]]
        flat = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(here, n), self.langs[flat], self.values[flat]


def _grouped(keys: np.ndarray, langs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, each once, the sums of n, and how many were joined to each."""
    order = np.lexsort((langs, keys))
    keys, langs, n = keys[order], langs[order], n[order]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (langs[1:] != langs[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], langs[new], np.add.reduceat(n, new) if len(new) else n, np.diff(np.append(new, len(keys)))


class Model:
    """Code lengths in bits of the grams that each language has seen, and escapes of the contexts that it has; of all orders, and nothing else."""

    def __init__(self, langs: list[str], grams: np.ndarray, of: np.ndarray, counts: np.ndarray):
        """A count for each pair of a gram and a language's number."""
        self.langs = langs
        self.seen, self.escapes = {}, {}
        keys, own, n, _ = _grouped(grams.astype(np.int64), of.astype(np.int64), counts.astype(np.int64))
        for order in range(GRAM, 0, -1):
            context, lang, total, kinds = _grouped(keys >> 8, own, n)
            whole = np.log2(total + kinds)
            # The pair of each gram among the pairs of contexts: both are sorted by (key, language).
            wide = len(langs) + 1
            at = np.searchsorted(context * wide + lang, (keys >> 8) * wide + own)
            self.seen[order] = Table(keys, own, whole[at] - np.log2(n))
            self.escapes[order] = Table(context, lang, whole - np.log2(kinds))
            keys, own, n, _ = _grouped(keys & ((1 << 8 * (order - 1)) - 1), own, n)  # counts of shorter grams: sums over the byte before

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of grams in every language: seen, or the escape of its context, if that was seen, and the shorter gram's."""
        out = np.full((len(grams), len(self.langs)), 8.0, np.float32)
        for order in range(1, GRAM + 1):
            own = grams & ((1 << 8 * order) - 1)
            at, lang, bits = self.escapes[order].entries(own >> 8)
            out[at, lang] += bits
            at, lang, bits = self.seen[order].entries(own)
            out[at, lang] = bits
        return out

    def bits(self, raws: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        total = np.zeros((len(raws), len(self.langs)))
        grams, starts = _grams(raws)
        step = max(1 << 10, min(CHUNK, 4 * CELLS // len(self.langs)))
        for lo in range(0, len(grams), step):
            part = grams[lo : lo + step]
            kinds, at = np.unique(part, return_inverse=True)
            kinds, some = kinds.astype(np.int64), max(1, CELLS // len(self.langs))
            own = np.concatenate([self.lengths(kinds[i : i + some]) for i in range(0, len(kinds), some)])
            first = max(int(np.searchsorted(starts, lo, "right")) - 1, 0)
            last = int(np.searchsorted(starts, lo + len(part), "left"))
            cuts = np.maximum(starts[first:last] - lo, 0)
            ends = np.append(cuts[1:], len(part))
            full = np.flatnonzero(ends > cuts)
            total[first + full] += np.add.reduceat(own[at], cuts[full], axis=0, dtype=np.float64)
        return total


def train(docs: DataFrame, per_language: int = 1500, least: int = 3) -> Model:
    """Counts the bytes of at most ``per_language`` documents of each language, whole texts, in tasks; only the sums by gram reach the driver.

    All languages are learned that have ``least`` different documents with a text; rarer labels, slips mostly, are not. The
    model has an entry for each language and gram that it has seen, so it grows with what the languages have, not with
    their number times all grams: 20 bytes for each pair of the longest order in a worker, and six times that at the peak on the driver.
    """
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text"))
    rows = cut(sample(known, "lang", per_language, "doc_id", "text"))
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("lang")
    counted = rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counted.join(common, "lang", "left_semi").toArrow()
    named = sums.column("lang").combine_chunks().dictionary_encode() if len(sums) else pa.array([], pa.string()).dictionary_encode()
    names = named.dictionary.to_pylist()
    langs = sorted(names)
    number = np.array([langs.index(x) for x in names], np.int64)
    return Model(langs, sums.column("gram").to_numpy(), number[named.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64), sums.column("n").to_numpy())


def shares(bits: np.ndarray) -> np.ndarray:
    """The best language's share if each had the same prior."""
    return 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the best language if each had the same prior) and bits (its code length) of every document."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # at most an entry for each byte of the sample's documents

    def run(batches):
        release()
        model = shared.value
        for batch in pieces(batches):
            strings = texts(batch)
            lettered = np.array([next(filter(str.isalpha, x), None) is not None for x in strings], bool) & bool(model.langs)
            rows = [("und", 0.0, 0.0)] * len(strings)
            which = np.flatnonzero(lettered)
            if len(which):
                bits = model.bits([strings[i].lower().encode() for i in which])
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(best)), best]
                for i, b, s, n in zip(which.tolist(), best.tolist(), shares(bits).tolist(), least.tolist()):
                    rows[i] = (model.langs[b], s, n)
            lang, score, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.float64())], names=["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def identify(docs: DataFrame, per_language: int = 1500) -> DataFrame:
    """Learns from the documents that are not held out and predicts all of them: doc_id, held_out, lang_pred, score and bits."""
    model = train(docs.where(~F.coalesce(held_out(), F.lit(True))), per_language)
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", "score", "bits")


def accepted(docs: DataFrame, model: Model, sure: float = 0.5) -> DataFrame:
    """The documents, whole rows, that have a letter and whose best language has more than the share ``sure``. The text passes the model where it lies, without a shuffle."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()
        model = shared.value
        for batch in pieces(batches):
            strings = texts(batch)
            keep = np.array([next(filter(str.isalpha, x), None) is not None for x in strings], bool) & bool(model.langs)
            which = np.flatnonzero(keep)
            if len(which):
                keep[which] = shares(model.bits([strings[i].lower().encode() for i in which])) > sure
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
