"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and how tokens of one go with the other's.

Both tokenizers cut a text's bytes into ranges. A token of either points to the token that reaches farthest to the
right among itself and those it overlaps; equal ends count for the first tokenizer's. Successors are doubled, all at
once, until none moves: then each token points to the last one of its group, which labels it. Ranges overlap in
one stretch each, so the links of a text are the stretches between the ends of its tokens.

How often two ids are linked is counted over all texts. Counts need not fit anywhere: a task cuts its texts
into blocks of ``BLOCK`` bytes and writes, next to its documents, each block's pairs of ids once with their
number, and each document's links as places in that list. Pairs meet their counts in a join by pair, and
return to their block, whose documents then look them up. So what is shuffled is a block's different pairs; a pair
that is everywhere has a row for each block and counts are summed before they are dealt out.

Defined results: a null or empty text, and one that either tokenizer does not give back byte by byte, has no tokens
and zeros; a very long text is aligned whole and a block by itself; repeated rows, equal and null ids get a row
each; of equal counts all are best; an empty table gives an empty result; other columns, of any name, are ignored.
"""

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import USUAL, _lists, load, splits_as_usual, token_bytes
from .common import fresh_path, pieces, prepare, resident, texts

BLOCK = 1 << 23
#: Pairs as one number: the first tokenizer's id above, the other's below.
LOW = (1 << 32) - 1


class Ends:
    """Where the tokens of both tokenizers end in a text's bytes, as marks on the bytes and how many marks there are before each."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray):
        self.a, self.b = a_ends, b_ends
        size = int(a_ends[-1]) + 1
        self.mark_a, self.mark_b = np.zeros(size, bool), np.zeros(size, bool)
        self.mark_a[a_ends], self.mark_b[b_ends] = True, True
        self.before_a, self.before_b = np.cumsum(self.mark_a, dtype=np.int32), np.cumsum(self.mark_b, dtype=np.int32)
        self.before_a -= self.mark_a
        self.before_b -= self.mark_b

    def successors(self) -> np.ndarray:
        """For each token (the first tokenizer's, then the other's) the one that reaches farthest among itself and those it overlaps.

        The farthest overlapping token of the other kind is the one that holds a token's last byte.
        """
        n, m = len(self.a), len(self.b)
        b_of_a, a_of_b = self.before_b[self.a], self.before_a[self.b]
        return np.concatenate([np.where(self.b[b_of_a] > self.a, n + b_of_a, np.arange(n)), np.where(self.a[a_of_b] >= self.b, a_of_b, n + np.arange(m))])

    def groups(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The group, numbered from 0 from left to right, of each token of the first tokenizer and of the other; and how many there are."""
        to = self.successors()
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        last = np.zeros(len(self.a), np.int64)  # last tokens are all the first tokenizer's
        last[to] = 1
        label = (np.cumsum(last) - 1)[to]
        return label[: len(self.a)], label[len(self.a) :], int(last.sum())

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the two tokens of each overlapping pair."""
        ends = np.flatnonzero(self.mark_a | self.mark_b)
        return self.before_a[ends], self.before_b[ends]


#: White space so long that tiktoken's search for matches runs out of stack.
_LONG_SPACE = re.compile(r"\s{500}")


class Bytes:
    """The first tokenizer, byte-level: ids of texts as the tokenizers library gives them.

    Where its merges stand in the order of the ids that they make, and texts are split as usual, tiktoken's encoder gives
    the same ids (both merge the pair with the lowest rank) in half the time. All else goes to the library itself.
    """

    def __init__(self, spec: dict):
        self.tok = load({**spec, "special": "text"})
        self.bytes = token_bytes(self.tok)
        self.widths = np.array([len(x) for x in self.bytes], np.int64)
        model, added = json.loads(self.tok.to_str())["model"], self.tok.get_added_tokens_decoder()
        usual = splits_as_usual(spec, self.tok)
        # A byte-level vocabulary with all bytes, and nothing that changes texts before, gives back what it got.
        self.exact = usual and {bytes([i]) for i in range(256)} <= {*self.bytes}
        self.fast = None
        if self.exact and model["type"] == "BPE" and not model.get("ignore_merges"):
            vocab, shown = model["vocab"], {x for x, i in model["vocab"].items() if i not in added}
            made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
            ids = [vocab[x] for x in made]
            if ids == sorted(set(ids)) and len(made) + 256 == len(shown):
                import tiktoken

                self.fast = tiktoken.Encoding("merges", pat_str=USUAL, mergeable_ranks={self.bytes[vocab[x]]: vocab[x] for x in shown}, special_tokens={})

    def encode(self, strings: list[str]) -> list[list[int] | None]:
        """Ids; None where their bytes are not those of the text."""
        out = []
        for text in strings:
            if self.fast and not _LONG_SPACE.search(text):
                out.append(self.fast.encode_ordinary(text))
                continue
            ids = self.tok.encode(text, add_special_tokens=False).ids
            out.append(ids if self.exact or b"".join(map(self.bytes.__getitem__, ids)) == text.encode() else None)
        return out


class Pieces:
    """The second tokenizer: a sentencepiece model, which puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(raw)]
        self.unknown = self.model.unk_id()

    def encode(self, strings: list[str]) -> list[list[int] | None]:
        """Ids; None where their bytes are not a blank and the text."""
        out = []
        for text, ids in zip(strings, self.model.encode(strings, num_threads=1)):
            # Pieces follow each other in the normalised text, unknown ones aside.
            same = self.unknown not in ids and "▁" not in text and self.model.normalize(text) == "▁" + text.replace(" ", "▁")
            out.append(ids if same or b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode() else None)
        return out


class Aligner:
    def __init__(self, a: dict, b: str):
        self.a, self.b = Bytes(a), Pieces(b)
        self.widths = self.a.widths, np.array([len(x) for x in self.b.bytes], np.int64)
        # Each id with what may follow it, in its list, at the list's end and at the group's end, in eight bytes.
        n = max(map(len, self.widths))
        if n > 10**7:
            raise ValueError("ids of more than seven digits")
        self.names = np.array([f"{i}{mark}".encode() for i in range(n) for mark in ",|;"], "S8").view(np.uint64)

    def tokens(self, strings: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by both tokenizers; None where a text has no tokens or its bytes do not come back."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(strings)
        full = [i for i, x in enumerate(strings) if x]
        for i, a, b in zip(full, self.a.encode([" " + strings[i] for i in full]), self.b.encode([strings[i] for i in full])):
            if a is not None and b is not None:
                out[i] = np.array(a, np.int64), np.array(b, np.int64)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, str, np.ndarray]:
        """The number of groups, the digest of their lists, and the linked pairs of ids."""
        ends = Ends(np.cumsum(self.widths[0][a]), np.cumsum(self.widths[1][b]))
        of_a, of_b, n = ends.groups()
        # A text's order of all tokens: by group, the first tokenizer's before the other's.
        a_until, b_until = np.cumsum(np.bincount(of_a, minlength=n)), np.cumsum(np.bincount(of_b, minlength=n))
        listed = np.zeros(len(a) + len(b), np.uint64)
        mark_a, mark_b = np.diff(of_a, append=n) > 0, 2 * (np.diff(of_b, append=n) > 0)
        listed[np.arange(len(a)) + np.concatenate([[0], b_until])[of_a]] = self.names[3 * a + mark_a]
        listed[np.arange(len(b)) + a_until[of_b]] = self.names[3 * b + mark_b]
        text = listed.tobytes().translate(None, b"\0")[:-1]
        i, j = ends.linked()
        return n, hashlib.sha256(text).hexdigest(), a[i] << 32 | b[j]


WRITTEN = "kind string, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<int>, pair long, n long"
_DOC = (("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()))


def _rows(kind: str, block: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = dict(_DOC) | {"places": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "pair": pa.int64(), "n": pa.int64()}
    out = {"kind": pa.array([kind] * rows, pa.string()), "block": pa.array(np.full(rows, block, np.int64))}
    return pa.RecordBatch.from_pydict(out | {c: columns.get(c, pa.nulls(rows, t)) for c, t in kinds.items()})


def _block(number: int, docs: list[tuple], pairs: list[np.ndarray]):
    """The rows of a block: its documents, and its different pairs in rising order."""
    found = [np.unique(p, return_counts=True) for p in pairs]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    times = np.concatenate([t for _, t in found])
    cuts = np.cumsum([len(k) for k, _ in found])[:-1]
    columns = {name: pa.array(values, kind) for (name, kind), values in zip(_DOC, zip(*docs))}
    yield _rows("doc", number, len(docs), **columns, places=_lists(np.split(at.astype(np.int32), cuts), pa.int32()), times=_lists(np.split(times.astype(np.int32), cuts), pa.int32()))
    total = np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)  # exact up to 2^53
    for i in range(0, len(keys), 1 << 16):
        yield _rows("pair", number, len(keys[i : i + (1 << 16)]), pair=pa.array(keys[i : i + (1 << 16)]), n=pa.array(total[i : i + (1 << 16)]))


def _look_up(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Adds each document's links that are their second id's best, and the sum of its links' counts."""
    order = np.argsort(pairs.column("pair").to_numpy(), kind="stable")
    counts, best = pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy()[order]
    places, times = docs.column("places").combine_chunks(), docs.column("times").combine_chunks()
    at, n = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())])
    sums = np.concatenate([[0], np.cumsum(n * counts[at])])
    bests = np.concatenate([[0], np.cumsum(n * best[at])])
    own = docs.select([name for name, _ in _DOC])
    return own.append_column("n_best", pa.array(np.diff(bests[ends]))).append_column("count_sum", pa.array(np.diff(sums[ends])))


def align(docs: DataFrame, a: dict, b: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    a: the first tokenizer, as ``bpe.load`` takes it; it gets each text behind a blank. b: the path of a sentencepiece model, which adds one.
    """
    spark = docs.sparkSession
    prepare(spark)

    def run(batches):
        aligner = resident(("align", *sorted(a.items()), b), lambda: Aligner(a, b))
        first, number = TaskContext.get().partitionId() << 32, 0
        held, pairs, size = [], [], 0
        for batch in pieces(batches):
            strings = texts(batch)
            for doc_id, text, both in zip(batch.column(0).to_pylist(), strings, aligner.tokens(strings)):
                if both is None:
                    held.append((doc_id, 0, 0, 0, 0, ""))
                    pairs.append(np.zeros(0, np.int64))
                else:
                    n, digest, links = aligner.align(*both)
                    held.append((doc_id, len(both[0]), len(both[1]), n, len(links), digest))
                    pairs.append(links)
                size += len(text) + 64
                if size >= block:
                    yield from _block(first | number, held, pairs)
                    held, pairs, size, number = [], [], 0, number + 1
        if held:
            yield from _block(first | number, held, pairs)

    path = fresh_path(spark, "alignment")
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, WRITTEN).write.partitionBy("kind").parquet(path)
    part = lambda kind: spark.read.schema(WRITTEN).parquet(path).where(F.col("kind") == kind)
    pairs = part("pair").select("block", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit(LOW))
    tops = counts.groupBy(second.alias("second")).agg(F.max("count").alias("top"))  # at most as many rows as the model has pieces
    valued = counts.join(F.broadcast(tops), second == F.col("second")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    told = pairs.select("block", "pair").join(valued, "pair").select("block", "pair", "count", F.col("best").cast("long").alias("best"))
    own = part("doc").select("block", *(name for name, _ in _DOC), "places", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_look_up, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
