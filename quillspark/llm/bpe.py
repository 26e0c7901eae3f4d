"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

``encode`` gives each document its ids and, for each id, the offset of the character in which its bytes
begin; ``decode`` puts the bytes of the ids together again. A character whose bytes are split between ids
has one offset for all of them, and is whole again once the bytes are joined.

Where a vocabulary splits texts by the usual pattern (``USUAL``), a text is split as that says (or, outside
Latin-1, cut before blanks that no match of the pattern crosses), and each distinct piece is encoded once by
the library and then remembered. With any other splitting, and where a text holds the string of an added
token, the library gets the whole text.

Defined results: null and empty texts have no ids; very long texts are encoded whole, and a batch holds one
of them at least; repeated rows are encoded each; an empty table gives an empty result; ids of documents may
be null or equal; other columns are kept, and an added column whose name is taken gets an underscore behind it.
"""

import base64
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free, pieces, prepare, resident, texts


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that merges as a rank file says: always the pair whose joined bytes have the lowest rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shown = byte_characters()
    names = {raw: "".join(map(shown.__getitem__, raw)) for raw in ranks}
    merges = [(names[raw[:i]], names[raw[i:]]) for raw in sorted(ranks, key=ranks.get) for i in range(1, len(raw)) if raw[:i] in ranks and raw[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={names[raw]: r for raw, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def load(spec: dict):
    """spec: {"file": a tokenizers JSON file} or {"ranks": a rank file, "pattern": its split pattern}.

    Added tokens of a file are met in texts, as the library does it; with "special": "text" their strings are ordinary text.
    """
    from tokenizers import Tokenizer

    if "ranks" in spec:
        return tokenizer_from_ranks(spec["ranks"], spec["pattern"])
    tok = Tokenizer.from_file(spec["file"])
    tok.encode_special_tokens = spec.get("special") == "text"
    return tok


#: The pattern of byte-level vocabularies that name none, and what the remembering of pieces stands for.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def splits_as_usual(spec: dict, tok) -> bool:
    """Whether texts are split by USUAL into bytes, and changed by nothing before."""
    if "ranks" in spec:
        return spec["pattern"] == USUAL
    parts = json.loads(tok.to_str())
    before = parts["pre_tokenizer"] or {}
    return parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)


#: USUAL for texts of Latin-1 characters only: there its classes can be written out.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A blank before which a text cannot be cut: it has white space on both sides. And the pieces of texts without one.
_RUN = re.compile(r"[\s\x85] (?=[\s\x85]|$)|^ (?=[\s\x85]|$)")
_UNITS = re.compile(r" ?[^ ]+| ")
#: A private character, used only between matches of _LATIN.
_BETWEEN = "\ue000"


class Encoder:
    """Encodes texts to little-endian ids of ``dtype``.

    Pieces of texts are remembered in two generations of up to ``limit`` each: when the younger one is full
    it becomes the older one, whose pieces return to the younger when they are met again.
    """

    def __init__(self, spec: dict, limit: int = 300_000, longest: int = 64):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.limit, self.longest = load(spec), limit, longest
        self.usual = splits_as_usual(spec, self.tok)
        added = [] if spec.get("special") == "text" else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else None
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.widths = np.array([len(x) for x in token_bytes(self.tok)], np.int64)
        self.matches = Tokenizer(self.tok.model)  # for text that is split into its matches already
        self.matches.pre_tokenizer = pre_tokenizers.Split(_BETWEEN, "removed")
        self.shown = str.maketrans({chr(b): c for b, c in byte_characters().items()})
        self.between = _BETWEEN.encode().decode("latin-1").translate(self.shown)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def split(self, parts: list[str], at_once: int = 2000) -> list[bytes]:
        """Ids of parts that are one match of the pattern each: all in one call, then cut by the widths of the ids."""
        out = []
        for i in range(0, len(parts), at_once):
            part = [x.encode() for x in parts[i : i + at_once]]
            text = _BETWEEN.encode().join(part).decode("latin-1").translate(self.shown).replace(self.between, _BETWEEN)
            ids = np.array(self.matches.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(x) for x in part])) + 1) * self.dtype.itemsize
            raw, ends = ids.tobytes(), ends.tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def learn(self, pieces: list[list[str]], encode) -> None:
        known, older = self.known, self.older
        new = list({x for x in chain.from_iterable(pieces) if x not in known})
        if older:
            known.update((x, older[x]) for x in new if x in older)
            new = [x for x in new if x not in known]
        known.update(zip(new, encode(new)))

    def encode(self, batch: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(batch)
        split = [i for i, x in enumerate(batch) if not (self.added and self.added(x))] if self.usual else []
        latin = [i for i in split if batch[i].isascii() or len(batch[i].encode("latin-1", "ignore")) == len(batch[i])]
        others = sorted({*split} - {*latin})
        pieces = [_LATIN.findall(batch[i]) for i in latin]
        self.learn(pieces, self.split)
        lookup = self.known.__getitem__
        for i, parts in zip(latin, pieces):
            out[i] = b"".join(map(lookup, parts))
        # In other scripts a text is cut before blanks, which no match crosses where a visible character comes before or behind.
        plain = [i for i in others if not _RUN.search(batch[i])]
        pieces = [_UNITS.findall(batch[i]) for i in plain]
        self.learn(pieces, self.whole)
        for i, parts in zip(plain, pieces):
            out[i] = b"".join(map(lookup, parts))
        rest = sorted({*range(len(batch))} - {*latin, *plain})
        for i, ids in zip(rest, self.whole([batch[i] for i in rest])):
            out[i] = ids
        if len(self.known) > self.limit:
            self.known, self.older = {x: v for x, v in self.known.items() if len(x) <= self.longest}, {}
            if len(self.known) > self.limit:
                self.known, self.older = {}, self.known
        return out


#: Byte tables: small, and kept.
_cache: dict = {}


def encoder(spec: dict) -> Encoder:
    """One for each worker, with what it remembers, until another vocabulary or operator needs the memory."""
    return resident(tuple(sorted(spec.items())), lambda: Encoder(spec))


def token_bytes(tok) -> list[bytes]:
    """The bytes of each id."""
    back = {c: b for b, c in byte_characters().items()}
    vocab = tok.get_vocab()
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for name, i in vocab.items():
        table[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
    return table


def byte_table(spec: dict) -> list[bytes]:
    """The bytes of each id, from the vocabulary's file alone."""
    key = tuple(sorted(spec.items()))
    if key not in _cache:
        if "ranks" in spec:
            with open(spec["ranks"], "rb") as f:
                ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
            _cache[key] = [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]
        else:
            _cache[key] = token_bytes(load(spec))
    return _cache[key]


def char_starts(text: bytes, ids: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each id the offset of the character that its first byte belongs to, and how many begin inside a character."""
    begins = np.cumsum(widths[ids]) - widths[ids]
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return (np.cumsum(lead) - 1)[begins].astype(np.int32), int(np.count_nonzero(~lead[begins]))


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.array([], np.int32), kind))


def encode(docs: DataFrame, spec: dict, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int), ``starts`` (array of int: offsets of characters) and ``n_split`` (ids that begin inside a character). A name that is taken gets an underscore behind it."""
    added = free(docs, "ids", "starts", "n_split")
    prepare(docs.sparkSession)

    def run(batches):
        enc = encoder(spec)
        widths = enc.widths
        for batch in pieces(batches):
            strings = texts(batch, text)
            ids = [np.frombuffer(x, enc.dtype).astype(np.int32) for x in enc.encode(strings)]
            starts, split = zip(*(char_starts(s.encode(), i, widths) if s else (i, 0) for s, i in zip(strings, ids))) if strings else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids, pa.int32()), _lists(list(starts), pa.int32()), pa.array(split, pa.int32())], names=[*batch.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(added, (T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.IntegerType())))])
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, spec: dict, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids as ``out`` (binary), with an underscore behind a name that is taken. An id outside the vocabulary is an error; null ids decode to null."""
    (out,) = free(rows, out)
    prepare(rows.sparkSession)

    def run(batches):
        table = byte_table(spec)
        for batch in pieces(batches):
            column = batch.column(batch.schema.get_field_index(ids))
            found = [b"".join(map(table.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))
