"""BPE encoding and decoding with a table of distinct words.

Words are cut at white space, so that each keeps the white space before it
(``space="leading"``, for vocabularies that encode it) or none (``"none"``, for
vocabularies that drop it); the pieces of a word then never depend on its
neighbours. A text that holds a string of an added token is one word.

Texts are dealt by a hash of the row to blocks, whose number follows the bytes of
the input. A block's distinct words go to shards by their hash; a shard holds all
places of its words, encodes each distinct word once with the tokenizers library, and
answers every block; a block then joins the ids to its texts by position. So a word
that fills half of all texts is one entry a block, and neither texts nor ids pass
through the driver. What a block sends depends on its rows alone, so a lost
executor's work can be done again.

Decoding joins every id to its piece: the id-to-piece table has as many rows as
the vocabulary, whatever the input, and is handed to all tasks.

Null text counts as empty and gives no ids; null ids give null text. Rows keep their columns
(``keep`` names those wanted), whatever their names; the columns made replace columns of
their own name. Repeated rows are encoded like any other, and an empty table gives
no rows. A text of any length is taken whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEADING = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: ASCII white space alone is left out of words; other white space stays for the library to treat.
BARE = re.compile(r"[^\t-\r ]+")

#: Bytes of text to a block, which a task holds with its words, and to a shard of the words, about.
BLOCK_BYTES = 1 << 23
SHARD_BYTES = 1 << 25
#: Longer words are encoded where they stand and not remembered, so that a memory bounded in words is bounded in bytes.
LONGEST_REMEMBERED = 64
#: A batch is encoded in slices of at most so many characters, or one text.
SLICE_CHARS = 4_000_000


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def added_tokens(path: str) -> list[str]:
    """Strings that the library reads as added tokens wherever they stand."""
    with open(path) as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


@cache
def specials(path: str) -> re.Pattern | None:
    """A pattern of the added tokens."""
    added = added_tokens(path)
    return re.compile("|".join(map(re.escape, added))) if added else None


def split_words(text: str, space: str) -> list[str]:
    return (LEADING if space == "leading" else BARE).findall(text)


def split_texts(texts: list[str], path: str, space: str) -> list[list[str]]:
    special = specials(path)
    return [[x] if special and special.search(x) else split_words(x, space) for x in texts]


def encode_words(words: list[str], path: str) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit numbers."""
    found = tokenizer(path).encode_batch_fast(words, add_special_tokens=False)
    return [array("I", x.ids).tobytes() for x in found]


class Encoder:
    """Encodes texts, given as UTF-8 bytes, word by word with a bounded memory, for tasks that encode in place.

    The memory has two generations of about ``most`` words of up to LONGEST_REMEMBERED bytes: when the young one is
    full it becomes the old one, and words met again move back. It lasts as long as the Python worker, over tasks.
    Words are cut at ASCII white space, which they do not keep.
    """

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.added = [x.encode() for x in added_tokens(path)]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [[x] if any(a in x for a in self.added) else x.split() for x in texts]  # bytes are split as BARE does
        young, old = self.young, self.old
        missing = set().union(*split).difference(young)
        unknown = list(missing.difference(old))
        missing.difference_update(unknown)
        young.update((w, old[w]) for w in missing)
        young.update(zip(unknown, encode_words([w.decode() for w in unknown], self.path), strict=True))
        ids_of = young.__getitem__
        out = [b"".join(map(ids_of, words)) for words in split]
        for w in unknown:
            if len(w) > LONGEST_REMEMBERED:
                del young[w]
        if len(young) > self.most:
            self.young, self.old = {}, young
        return out


@cache
def encoder(path: str, most: int) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path, most)


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    held, chars = [], 0
    for x in texts:
        x = x or ""
        if held and chars + len(x) > SLICE_CHARS:
            yield held
            held, chars = [], 0
        held.append(x)
        chars += len(x)
    if held:
        yield held


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as bytes: how many, how wide, then zstd of them."""
    width = 4 if not len(numbers) or numbers.max() < 1 << 32 else 8
    return len(numbers).to_bytes(8, "little") + bytes([width]) + pa.compress(numbers.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def unpack_numbers(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    return np.frombuffer(pa.decompress(blob[9:], decompressed_size=width * n, codec="zstd"), f"<u{width}")


def pack_words(words: list[str]) -> bytes:
    """Words as bytes: the length of their UTF-8 forms, cut by a byte that UTF-8 never has, then zstd of these."""
    raw = b"\xff".join(w.encode() for w in words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_words(blob: bytes) -> list[str]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return [w.decode() for w in raw.split(b"\xff")]


def pack_text(text: str | None) -> bytes:
    raw = (text or "").encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_text(blob: bytes) -> str:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True).decode()


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their texts compressed, for the one time they move."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            packed = pa.array([pack_text(x.as_py()) for x in part.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("row"), packed, part.column("block")], ["row", "text", "block"])


def _by_shard(words: list[str], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by shard and spelling, and each word's shard in that order."""
    spelled = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    at = np.fromiter((zlib.crc32(words[i].encode()) % shards for i in spelled), np.int64, len(words))
    order = np.argsort(at, kind="stable")
    return spelled[order], at[order]


def _words_of_block(path: str, space: str, shards: int):  # noqa: ANN202
    """The distinct words of a block, by shard."""

    def collect(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for part in parts:
            for texts in _slices([unpack_text(x) for x in part.column("text").to_pylist()]):
                found = found.union(*split_texts(texts, path, space))
        words = list(found)
        order, at = _by_shard(words, shards)
        own, first = np.unique(at, return_index=True)
        lists = [pack_words([words[j] for j in some]) for some in np.split(order, first[1:])] if len(own) else []
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(lists), pa.int32()), pa.array(own, pa.int32()), pa.array(lists, pa.binary())], ["block", "shard", "words"])

    return collect


def _encode_shard(path: str):  # noqa: ANN202
    """Each distinct word of a shard encoded once, for all blocks."""

    def encode_all(_: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, bytes] = {}
        for part in parts:
            lists = [unpack_words(x.as_py()) for x in part.column("words")]
            new = list(dict.fromkeys(w for words in lists for w in words if w not in table))
            table.update(zip(new, encode_words(new, path), strict=True))
            sizes, ids = [], []
            for words in lists:
                found = [table[w] for w in words]
                sizes.append(pack_numbers(np.fromiter((len(x) // 4 for x in found), np.int64, len(found))))
                ids.append(pack_numbers(np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_arrays([part.column("block"), part.column("shard"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["block", "shard", "sizes", "ids"])

    return encode_all


def _join_block(path: str, space: str, shards: int):  # noqa: ANN202
    """``row`` and ``ids`` of the texts of one block, whose words come back in the order in which they were sent."""

    def join(texts: pa.Table, known: pa.Table) -> pa.Table:
        names: dict[str, int] = {}
        held: list[tuple[pa.Array, list[np.ndarray]]] = []
        for batch in texts.select(["row", "text"]).to_batches():
            at = 0
            for some in _slices([unpack_text(x) for x in batch.column("text").to_pylist()]):
                codes = [np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words)) for words in split_texts(some, path, space)]
                held.append((batch.column("row").slice(at, len(some)), codes))
                at += len(some)
        order, _ = _by_shard(list(names), shards)
        names.clear()
        rows = np.argsort(known.column("shard").to_numpy()).tolist()
        numbers = lambda c: np.concatenate([np.empty(0, np.uint32), *(unpack_numbers(known.column(c)[i].as_py()) for i in rows)])
        sizes, flat = np.empty(len(order), np.int64), numbers("ids").astype(np.int32)
        sizes[order] = sent = numbers("sizes").astype(np.int64)
        starts = np.empty(len(order), np.int64)
        starts[order] = np.cumsum(sent) - sent
        parts = []
        for row, codes in held:
            every = np.concatenate([np.empty(0, np.int32), *codes])
            n = sizes[every]
            ends = np.cumsum(n)
            ids = flat[np.repeat(starts[every] - (ends - n), n) + np.arange(int(n.sum()))]
            upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, codes)])]
            parts.append(pa.RecordBatch.from_arrays([row, _lists(ids, np.diff(upto))], ["row", "ids"]))
        return pa.Table.from_batches(parts)

    return join


def encode(docs: DataFrame, path: str, text: str = "text", space: str = "leading", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, by default all) with the ids that the tokenizers library gives each text, without special tokens around it."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != ids]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    row = F.struct(*keep).alias("row")
    block = F.pmod(F.xxhash64(*dict.fromkeys([*keep, text])), F.lit(1 + size // BLOCK_BYTES)).cast("int").alias("block")
    dealt = docs.select(row, F.col(text).alias("text"), block)
    moved = T.StructType([dealt.schema["row"], T.StructField("text", T.BinaryType()), T.StructField("block", T.IntegerType())])
    dealt = dealt.mapInArrow(_squeezed, moved)
    shards = 1 + size // SHARD_BYTES
    words = dealt.groupBy("block").applyInArrow(_words_of_block(path, space, shards), "block int, shard int, words binary")
    known = words.groupBy("shard").applyInArrow(_encode_shard(path), "block int, shard int, sizes binary, ids binary")
    schema = T.StructType([dealt.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    joined = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_join_block(path, space, shards), schema)
    return joined.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("ids").alias(ids))


@cache
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every id, one after another, and where each id's bytes start."""
    # Byte-level vocabularies write printable bytes as themselves, the others as code points from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    with open(path) as f:
        loaded = json.load(f)
    pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in loaded["model"]["vocab"].items()}
    pieces |= {x["id"]: x["content"].encode() for x in loaded["added_tokens"]}
    ordered = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    ends = np.zeros(len(ordered) + 1, np.int64)
    np.cumsum([len(x) for x in ordered], out=ends[1:])
    return np.frombuffer(b"".join(ordered), np.uint8), ends


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids: every id joined to its piece, broken UTF-8 replaced. Null ids give null."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, starts = piece_table(path)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.zeros(part.num_rows + 1, np.int64)
                np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), out=ends[1:])
                sizes = starts[flat + 1] - starts[flat]
                after = np.concatenate([[0], np.cumsum(sizes)])
                source = np.repeat(starts[flat] - after[:-1], sizes) + np.arange(after[-1])
                joined, cuts = pieces[source].tobytes(), after[ends]
                texts = [joined[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                made = pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, text])

    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    return rows.mapInArrow(add, schema)
