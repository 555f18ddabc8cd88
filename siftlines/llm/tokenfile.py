"""Token ids of all documents in files of patched frame-of-reference blocks, and reading them back.

Documents are range-sorted by id, and each range becomes one part of a Parquet table.  A row of it is a page: some
consecutive documents with their ids and numbers of tokens, and one byte string with the pages's token ids in
blocks.  A block holds up to ``BLOCK`` ids: their minimum, a width in bits that suffices for ``PERCENTILE`` percent of
the differences to it, the differences packed at that width (low bits of larger ones), and the exceptions: positions and what
exceeds the width.  ``block_starts`` has the byte at which each block begins, so a block is found without reading
others.

Null texts are empty and hold only the end id; null ids come first; rows with the same id are next to each other
in the order of their texts' hashes; an empty table gives files without pages and an empty result.
"""

import json
import os
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from siftlines.llm import common

END_ID = 1
END = np.array([END_ID], "<u4")
BLOCK = 4096
PERCENTILE = 90
#: A page ends with the document that reaches so many ids.
PAGE_IDS = 1 << 16
#: Once a task knows more pieces than this it forgets those that its last texts do not hold.
REMEMBERED = 1 << 18

#: The sign that stands for a byte in a byte-level vocabulary: itself if it can be printed, else one past Latin-1.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SIGNS = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED) if b != 0x20}
#: What a word may not hold to be cut without the library: all but printed ASCII and letters of Latin-1, small or large.
UNCUT = re.compile("[^\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: The pieces of other words once their letters are small, as the pattern of ``WORDWISE`` cuts them; words are lines.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|\n|[^a-z0-9\x80-\xff\n]+")


#: How a vocabulary has to prepare texts for its words to be encoded apart.
WORDWISE = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})


def wordwise(vocabulary: dict) -> bool:
    """Whether words can be encoded apart: ``WORDWISE``, plain merges that know each byte, and no added token that is changed or
    holds white space."""
    model, added = vocabulary["model"], vocabulary["added_tokens"]
    return ((vocabulary["normalizer"], vocabulary["pre_tokenizer"]) == WORDWISE and model["type"] == "BPE"
            and model["end_of_word_suffix"] == "</w>" and not model["dropout"]
            and all(f"{chr(SIGNS.get(b, b))}{end}" in model["vocab"] for b in range(0x100) if b != 0x20 for end in ("", "</w>"))
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added))


def encode_block(values: np.ndarray) -> bytes:
    """One block: 4 header words (count, minimum, width, exceptions), packed differences, exceptions."""
    least = int(values.min())
    rest = values - np.uint32(least)
    enough = int(np.ceil((len(values) - 1) * (PERCENTILE / 100)))
    width = int(np.partition(rest, enough)[enough]).bit_length()
    size = (width + 7) // 8  # bytes that have bits to pack
    used = rest.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size]
    bits = np.unpackbits(used.reshape(-1), bitorder="little").reshape(-1, 8 * size)[:, :width] if width else used
    packed = np.packbits(bits, bitorder="little").tobytes()
    odd = np.flatnonzero(rest > np.uint32((1 << width) - 1)).astype("<u4")
    high = (rest[odd] >> np.uint32(width)).astype("<u4")
    head = np.array([len(values), least, width, len(odd)], "<u4").tobytes()
    return head + packed + odd.tobytes() + high.tobytes()


def decode_block(data: bytes, start: int) -> np.ndarray:
    n, least, width, n_odd = np.frombuffer(data, "<u4", 4, start).tolist()
    at, size = start + 16, (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    rest = np.packbits(bits, bitorder="little").view("<u4").astype(np.uint32)
    odd = np.frombuffer(data, "<u4", n_odd, at + size)
    high = np.frombuffer(data, "<u4", n_odd, at + size + 4 * n_odd)
    rest[odd] |= high << np.uint32(width)
    return rest + np.uint32(least)


def encode_page(ids: np.ndarray) -> tuple[bytes, list[int]]:
    blocks = [encode_block(ids[at:at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    sizes = [len(b) for b in blocks]
    return b"".join(blocks), [0, *np.cumsum(sizes[:-1]).tolist()] if blocks else []


def decode_page(data: bytes, block_starts: list[int]) -> np.ndarray:
    return np.concatenate([decode_block(data, at) for at in block_starts]).astype("<u4")


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``which`` of ``flat`` in a row, and where each ends; entry i is ``sizes[i]`` long and begins at ``starts[i]``."""
    size = sizes[which]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Known:
    """Pieces as a column, the ids of all of them in a row, how many each has and where they begin."""

    def __init__(self, pieces: pa.Array, flat: np.ndarray, sizes: np.ndarray):
        self.pieces, self.flat, self.sizes, self.starts = pieces, flat, sizes, np.cumsum(sizes) - sizes

    def __add__(self, other: "Known") -> "Known":
        return Known(pa.concat_arrays([self.pieces, other.pieces]), np.concatenate([self.flat, other.flat]),
                     np.concatenate([self.sizes, other.sizes]))

    def take(self, places: np.ndarray) -> "Known":
        return Known(self.pieces.take(pa.array(places)), gathered(self.flat, self.starts, self.sizes, places)[0], self.sizes[places])


def encoder(path: str):
    """Ids of many texts at once.

    White space separates tokens and leaves none, so a text is the sequence of its words, and the case of A-Z is lost.  Words of
    printed ASCII and letters of Latin-1 are cut into pieces here, which the vocabulary's merges get many at once; the last token
    of a piece says that it is the last.  Other words go through the library one by one.  Words and pieces stay columns and their
    ids arrays.  Each different piece and other word is encoded once as long as it is remembered; once ``REMEMBERED`` are, those
    go that the texts at hand do not hold.

    All this holds for ``WORDWISE`` vocabularies; another one's texts go through the library as they are.  So does a text that spells a
    special token in letters that are not all small: the library looks for those before it changes the case.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
    tokenizer = Tokenizer.from_file(path)
    whole = lambda text: np.array(
        [*tokenizer.encode(text, add_special_tokens=False).ids, END_ID], "<u4")
    vocabulary = json.loads(tokenizer.to_str())
    if not wordwise(vocabulary):
        return lambda texts: [whole((text or "").encode("utf-8", "replace").decode())
                              for text in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
    signs = [t["content"] for t in vocabulary["added_tokens"]]
    special = re.compile("|".join(map(re.escape, signs)) or "(?!)", re.IGNORECASE)
    hint = os.path.commonprefix(signs)[:1]  # a sign looked for first; empty: all texts are looked through
    merges = Tokenizer(tokenizer.model)
    merges.pre_tokenizer = WhitespaceSplit()
    tokens, suffix = vocabulary["model"]["vocab"], vocabulary["model"]["end_of_word_suffix"]
    last = np.zeros(max([*tokens.values(), *(t["id"] for t in vocabulary["added_tokens"])]) + 1, bool)
    last[[i for token, i in tokens.items() if token.endswith(suffix)]] = True
    printed = np.array([SIGNS.get(b, b) for b in range(0x100)], "<u4")
    known = Known(pa.array([b"\n"]), np.empty(0, "<u4"), np.zeros(1, np.int64))  # the end of a line stays first

    def ended(words: pa.Array, by: bytes) -> bytes:
        return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), by)[0].as_py() + by if len(words) else b""

    def merged(pieces: pa.Array) -> Known:
        flat, sizes = [known.flat[:0]], [known.sizes[:0]]
        for at in range(0, len(pieces), 10_000):
            text = printed[np.frombuffer(ended(pieces.slice(at, 10_000), b" "), np.uint8)].tobytes().decode("utf-32-le")
            flat.append(np.array(merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
            sizes.append(np.diff(np.flatnonzero(last[flat[-1]]), prepend=-1))
        return Known(pieces, np.concatenate(flat), np.concatenate(sizes))

    def by_library(words: pa.Array) -> Known:
        flat, sizes = array("I"), []
        for at in range(0, len(words), 2000):
            some = [word.decode() for word in words.slice(at, 2000).to_pylist()]
            for found in tokenizer.encode_batch_fast(some, add_special_tokens=False):
                flat.extend(found.ids)
                sizes.append(len(found.ids))
        return Known(words, np.array(flat, "<u4"), np.array(sizes, np.int64))

    def uncut(words: pa.Array) -> np.ndarray:
        return np.array(pc.match_substring_regex(words.cast(pa.string()), UNCUT.pattern), bool)

    def places_of(pieces: pa.Array) -> np.ndarray:
        """Where each of them is known, now at least."""
        nonlocal known
        places = pc.fill_null(pc.index_in(pieces, known.pieces), -1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(places < 0)
        odd = uncut(pieces.take(pa.array(new)))
        new = np.concatenate([new[~odd], new[odd]])
        places[new] = len(known.pieces) + np.arange(len(new))
        known += merged(pieces.take(pa.array(new[:len(new) - odd.sum()])))
        if odd.any():
            known += by_library(pieces.take(pa.array(new[len(new) - odd.sum():])))
        return places

    def encode_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in some order, where each word's begin and how many they are."""
        nonlocal known
        alone = np.array(pc.ascii_is_alpha(words.cast(pa.string())), bool)
        alone[~alone] = uncut(words.filter(pa.array(~alone)))
        cut = PIECES.findall(ended(words.filter(pa.array(~alone)), b"\n").decode().lower().encode())
        pieces = pc.dictionary_encode(pa.concat_arrays([words.filter(pa.array(alone)), pa.array(cut, pa.binary())]))
        different, code = pieces.dictionary, pieces.indices.to_numpy(zero_copy_only=False)
        places = places_of(different)
        flat, ends = gathered(known.flat, known.starts, known.sizes, places[code])
        done = places[code] == 0
        done[:alone.sum()] = True
        if len(known.pieces) > REMEMBERED:
            known = known.take(np.union1d(places, 0))
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        order = np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])
        sizes[order] = np.diff(ends[done], prepend=0)
        starts[order] = ends[done] - sizes[order]
        return flat, starts, sizes

    def encode(texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array([(text or "").encode("utf-8", "replace") for text in texts], pa.binary()).cast(pa.string())
        odd = [i for i in np.flatnonzero(pc.match_substring(pc.fill_null(texts, ""), hint)) if special.search(texts[i].as_py())]
        plain = pc.if_else(~np.isin(np.arange(len(texts)), odd), texts, "") if odd else texts
        words, code, lengths = common.coded(plain)
        flat, starts, sizes = encode_words(words)
        ids, ends = gathered(np.append(END, flat), np.append(0, starts + 1), np.append(1, sizes), code)
        found = np.split(ids, ends[np.cumsum(lengths) - 1][:-1])[:len(texts)]
        for i in odd:
            found[i] = whole(texts[i].as_py())
        return found

    return encode


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token file of ``docs`` below ``path``; ``tokenizer`` names a file on every executor."""
    n = common.partitions(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    ranged = slim.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        names, ids, held, page, start = [], [], 0, 0, 0
        id_type = None

        def full() -> pa.RecordBatch:
            data, starts = encode_page(np.concatenate(ids))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([page], pa.int32()), pa.array([start], pa.int64()),
                pa.array([held], pa.int64()), pa.array([names], pa.list_(id_type)),
                pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())),
                pa.array([data], pa.binary())],
                ["part", "page", "start", "n_ids", "doc_ids", "n_tokens", "block_starts", "blocks"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for some in common.slices(batch, 1):
                for name, value in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    names.append(name)
                    ids.append(value)
                    held += len(value)
                    if held >= PAGE_IDS:
                        yield full()
                        names, ids, held, page, start = [], [], 0, page + 1, start + held
        if ids:
            yield full()

    ranged.mapInArrow(pages, f"part int, page int, start long, n_ids long, doc_ids array<{kind}>, n_tokens array<long>, "
                             "block_starts array<long>, blocks binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token file, from its decoded pages."""
    pages = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pages.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per file
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    kind = pages.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                lengths = np.array(page["n_tokens"], np.int64)
                ends = np.cumsum(lengths)
                raw = decode_page(page["blocks"], page["block_starts"]).tobytes()
                sums = [crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(page["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(page["start"] + page["part_start"] + ends - lengths, pa.int64()),
                    pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = pages.join(F.broadcast(starts), "part").select(
        "start", "part_start", "doc_ids", "n_tokens", "block_starts", "blocks")
    return placed.mapInArrow(documents, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
