"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import functools
import json
import math
import os
import re
import struct
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import sliced

#: Tokens in a sequence, open bins of a packer, rows that one packer takes, words and parts of them that a worker remembers.
CAPACITY, OPEN_BINS, ROWS_PER_PACKER, REMEMBERED, REMEMBERED_PARTS = 2048, 2048, 50_000, 100_000, 400_000
#: Pieces that are put in order, longest first, before they are placed one by one.
LOOK_AHEAD = 2048


#: Stretches of plain characters (ASCII and composed Latin letters, whose lower case is one letter each) and what the
#: vocabulary's own pattern cuts them into once they are lower-cased.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PLAIN_TEXT = re.compile("[\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
_MARKS = re.compile("[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017f]+")
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable Latin-1 as itself, the others in turn from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()


#: What a vocabulary's file must say of normalising and splitting for the stretches and parts here to hold.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
}


class WordIds(dict):
    """Token ids of stretches between ASCII white space, as little-endian bytes, remembered up to a bound.

    Where the vocabulary's file normalises and splits as _ASSUMED says, it drops ASCII white space and no pre-token crosses
    it, so a text's ids are those of its stretches; a plain stretch's ids are those of its parts, which repeat far more often.
    Plain texts are cut into parts as a whole. Anything else, and every text of another vocabulary, goes to the tokenizer as
    it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.known = all(said.get(k) == v for k, v in _ASSUMED.items()) and said["model"]["type"] == "BPE" and all("<|" in t["content"] for t in said.get("added_tokens") or [])
        self.parts: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encode(texts, add_special_tokens=False)]

    def encoded_parts(self, parts: list[str]) -> list[bytes]:
        """Parts are pre-tokens already: the vocabulary's model takes them as they are, once bytes are written as its characters."""
        out = []
        for part in parts:
            tokens = self.tokenizer.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARACTERS))
            out.append(struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens]))
        return out

    def learn(self, words: list[bytes]) -> None:
        cut, whole = [], []
        for word in words:
            text = word.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                cut.append((word, _PARTS.findall(text.lower())))
            else:
                whole.append((word, text))
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts.clear()
        new = list({p for _, parts in cut for p in parts if p not in self.parts})
        self.parts.update(zip(new, self.encoded_parts(new), strict=True))
        for word, parts in cut:
            self[word] = b"".join([self.parts[p] for p in parts])
        self.update(zip([w for w, _ in whole], self.encoded([t for _, t in whole]), strict=True))

    def plain_ids(self, texts: list[str]) -> list[bytes]:
        split = [_MARKS.sub(r" \g<0> ", t.lower()).split() for t in texts]
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts.clear()
        new = list(set().union(*split).difference(self.parts))
        if new:
            self.parts.update(zip(new, self.encoded_parts(new), strict=True))
        return [b"".join(map(self.parts.__getitem__, parts)) for parts in split]

    def stretch_ids(self, texts: list[str]) -> list[bytes]:
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self) > REMEMBERED:
            self.clear()
        new = {w for words in split for w in set(words) if w not in self}
        if new:
            self.learn(list(new))
        return [b"".join(map(self.__getitem__, words)) for words in split]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return self.encoded(texts)
        plain = [_PLAIN_TEXT.fullmatch(t) is not None and "'" not in t and "<|" not in t for t in texts]
        one, other = iter(self.plain_ids([t for t, p in zip(texts, plain, strict=True) if p])), iter(self.stretch_ids([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(one if p else other) for p in plain]


@functools.cache
def worker_words(path: str) -> WordIds:
    """One memory for all tasks of a worker process."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids: each document's ids (unsigned 32-bit, little-endian) and ``end_id``, cut at ``capacity``.

    ``tokenizer`` is the path of a vocabulary file on the workers. A null or empty text is ``end_id`` alone. Every
    row is a document, equal rows too; columns besides doc_id and text are ignored; texts are read whole.
    """
    rows = docs.select("doc_id", "text")
    step, end = 4 * capacity, struct.pack("<I", end_id)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(tokenizer)
        for part in sliced(batches):
            taken, piece, data = [], [], []
            for i, ids in enumerate(words.ids([t or "" for t in part.column(1).to_pylist()])):
                ids += end
                for n, begin in enumerate(range(0, len(ids), step)):
                    taken.append(i)
                    piece.append(n)
                    data.append(ids[begin : begin + step])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(taken, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array([n * capacity for n in piece], pa.int64()),
                    pa.array([len(d) // 4 for d in data], pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each length, in order: the open bin with the least space that still holds it, else a new bin.

    The bins are found through a bitset whose bit f is set while an open bin has f free places; when too many are
    open, the fullest closes.
    """
    bits, bins, opened, n_open = 0, [[] for _ in range(capacity + 1)], 0, 0
    for length in lengths:
        fitting = bits >> length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + length
            which = bins[free].pop()
            n_open -= 1
            if not bins[free]:
                bits ^= 1 << free
        else:
            free, which, opened = capacity, opened, opened + 1
        yield which, capacity - free
        if free > length:
            least = (bits & -bits).bit_length() - 1
            if n_open == open_bins:
                if free - length <= least:
                    continue  # the bin just filled is the fullest
                bins[least].pop()
                n_open -= 1
                if not bins[least]:
                    bits ^= 1 << least
            bins[free - length].append(which)
            bits |= 1 << (free - length)
            n_open += 1


def pack_pieces(pieces: DataFrame, rows: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, rows_per_packer: int = ROWS_PER_PACKER) -> DataFrame:
    """``pieces`` (with doc_id, piece, length <= ``capacity``) with ``sequence_id`` and ``offset``.

    ``rows`` tells about how many there are. They are dealt by hash, each row's place in its partition included (so equal
    rows part), to one packer for each ``rows_per_packer``; each packs its own in hashed order, LOOK_AHEAD at a time longest first, with ``open_bins`` open bins, so memory is bounded and a rerun of a lost
    packer gives the same sequences. Ties and repeated rows are packed like any others; no rows give no rows.
    """
    packers = max(1, math.ceil(rows / rows_per_packer))
    mixed = F.xxhash64("doc_id", "piece", "length", *(["ids_crc32"] if "ids_crc32" in pieces.columns else []), F.monotonically_increasing_id())
    dealt = pieces.withColumn("__h", mixed).repartition(packers, "__h").sortWithinPartitions("__h", "doc_id", "piece")
    names = [*pieces.columns, "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        arriving: deque[int] = deque()
        places = best_fit(iter(arriving.popleft, None), capacity, open_bins)
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            found: list[tuple[int, int]] = [(0, 0)] * len(lengths)
            for at in range(0, len(lengths), LOOK_AHEAD):
                order = sorted(range(at, min(at + LOOK_AHEAD, len(lengths))), key=lambda i: (-lengths[i], i))
                arriving.extend(lengths[i] for i in order)
                for i in order:
                    found[i] = next(places)
            columns = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([base + p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names)

    return dealt.mapInArrow(pack, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, keep_ids: bool = False, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Every document packed: its pieces with ids' CRC-32 (and the ids, if kept), sequence and offset."""
    pieces = token_pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return pack_pieces(pieces.select(*columns), docs.count(), capacity, open_bins)
