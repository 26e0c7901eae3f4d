"""Quality rules: failures of several rules of a document's own, judged again by the host it comes from.

Each document gets counts over its whole text, a verdict of its own (``base_failed``), and what other rules say of it:
symbols, repeated lines, and words of unusual length. Failures are summed by host and rule. The hosts' rates of a rule
come from a beta distribution that is fitted to all hosts by moments; the spread that is only that of drawing few
documents from a host is taken off first. With it as the prior each host has a posterior rate, which for a host of few
documents is near the population's. A host fails a rule where that rate is above the population's by more than
``margin``, or above ``max_rate``, and surely so: by ``sure`` posterior deviations besides. A host that fails any rule
takes all of its documents with it. Where hosts are alike none fails unless most of all documents do.

Defined results: a null text has no words (it fails the base rule); a null host belongs to no host and is judged by
the population's mean; very long texts are counted whole; repeated rows count as often as they occur; ids may be null
or equal; an empty table gives an empty result; other columns of the input, of any name, are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, join_keyed, pieces, prepare, release, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a document fails, over its counts and the number of its lines with a word.
RULES = {
    "base": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs at least twice. Windows are compared exactly: ranks of 1, 2, 4, ... words."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width, top = 1, len(seen)
    while width < window:
        step = min(width, window - width)
        kinds, ranks = np.unique(ranks[: len(ranks) - step] * top + ranks[step:], return_inverse=True)
        width, top = width + step, len(kinds)
        if top == len(ranks):
            return 0
    often = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[: len(often)] += often
    edges[window:] -= often
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def _stats(batches):
    release()
    for batch in pieces(batches):
        rows = []
        for text in texts(batch):
            raw = text.encode()
            words = raw.split()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            rows.append((len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)))
        columns = list(zip(*rows)) or [()] * (len(COUNTS) + 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "host", *COUNTS, "n_lines"])


def document_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the counts of each document, and whether it fails each rule, as failed_<rule>."""
    prepare(docs.sparkSession)
    schema = "doc_id long, host string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_lines"))
    stats = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text")).mapInArrow(_stats, schema)
    return stats.select("*", *(F.expr(rule).alias(f"failed_{name}") for name, rule in RULES.items()))


def strength(hosts: float, docs: float, failures: float, squares: float) -> tuple[float, float]:
    """Mean and strength (in documents) of the beta distribution of a rule's rates.

    The mean m is the share of failures among all documents. Were a host's failures drawn at a rate of its own from a beta
    distribution of strength s, the sum of n (rate - m)^2 over H hosts of N documents together would be
    m (1 - m) (H + (N - H) / (1 + s)) on average, which is solved for s; it is held between 1 and 10,000 documents.
    ``squares`` is the sum of failures^2 / n.
    """
    mean = failures / docs if docs else 0.0
    own = mean * (1 - mean)
    spread = (squares - docs * mean * mean) / own - hosts if own > 1e-12 else 0.0  # what sampling does not explain
    return mean, min(max((docs - hosts) / spread - 1 if spread > 1e-9 else 1e4, 1.0), 1e4)


def host_verdicts(stats: DataFrame, margin: float = 0.2, sure: float = 3.0, max_rate: float = 0.5) -> tuple[DataFrame, dict[str, float]]:
    """Per host its posterior base rate (host_rate) and the rules that it fails (host_failed, by name, comma-joined); and the rules' means."""
    failures = [F.sum(F.col(f"failed_{r}").cast("long")).alias(r) for r in RULES]
    hosts = cut(stats.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *failures))
    total = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), *(F.sum(r).alias(r) for r in RULES), *(F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_squares") for r in RULES)).first()
    means, rates, failed = {}, {}, []
    for rule in RULES:
        means[rule], s = strength(total.h, total.n or 0, total[rule] or 0, total[f"{rule}_squares"] or 0)
        rates[rule] = rate = (F.col(rule) + F.lit(means[rule] * s)) / (F.col("n") + F.lit(s))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(s + 1)))
        failed.append(F.when(rate - sure * deviation > min(means[rule] + margin, max_rate), F.lit(rule)))
    return hosts.select("host", rates["base"].alias("host_rate"), F.concat_ws(",", *failed).alias("host_failed")), means


def apply_rules(docs: DataFrame, host: str = "source", margin: float = 0.2, sure: float = 3.0, max_rate: float = 0.5) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept``, the host's posterior base rate and the rules that the host fails."""
    stats = cut(document_stats(docs, host))
    hosts, means = host_verdicts(stats, margin, sure, max_rate)
    judged = join_keyed(stats, hosts, "host", "doc_id")
    failed = F.coalesce("host_failed", F.lit(",".join(r for r, mean in means.items() if mean > max_rate)))
    return judged.select("doc_id", *COUNTS, F.col("failed_base").alias("base_failed"), (~F.col("failed_base") & (failed == "")).alias("kept"), F.coalesce("host_rate", F.lit(means["base"])).alias("host_rate"), failed.alias("host_failed"))
