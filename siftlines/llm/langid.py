"""Language identification by compression: the language whose dictionary packs a text smallest.

Each language has a zstandard raw-content dictionary of sampled training text.  A text's letters (in lower case, all
else as one space) are cut into blocks, every block is compressed with every dictionary, and the sizes are added up over
the whole text; the smallest sum wins.  A text whose two smallest sums lie too close together is rejected, unless
it is so short that a difference of single bytes says nothing.

The dictionaries are fitted on a bounded sample: ``DICTIONARY_BYTES`` per language, ``ALL_BYTES`` over all languages,
taken from training texts picked by a hash of their id at a rate that follows from the number of documents.

Null texts and texts without a letter are ``und`` with score 0 and rejected; ties go to the language with more
training documents, then to the first by name; without any training row all is ``und``.  Rows
repeated are judged each; an empty table gives an empty result.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlines.llm import common

DICTIONARY_BYTES = 1 << 17
ALL_BYTES = 1 << 23
#: Most bytes of one document in a dictionary.
EXCERPT_BYTES = 1 << 10
#: Texts are compressed in blocks of so many bytes.
BLOCK = 1 << 9
LEVEL = 3
#: Relative advantage below which a text is rejected.
MARGIN = 0.003
#: Shorter texts are not rejected for their margin.
SURE_BYTES = 64
UNKNOWN = "und"


NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of training documents."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = sorted(known.groupBy(lang_col).count().collect(), key=lambda r: (-r[1], r[0]))
    if not counts:
        return []
    room = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    wanted = 4 * room // EXCERPT_BYTES + 8
    rates = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, wanted / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("dictionary")), F.lit(1 << 30)) / (1 << 30)
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit("excerpt")),
                   F.greatest(F.lit(1), F.length(text_col) - EXCERPT_BYTES + 1)).cast("int") + 1
    sample = known.where(draw < F.element_at(rates, F.col(lang_col))).select(
        F.col(lang_col).alias("lang"), draw.alias("draw"),
        F.substring(F.col(text_col), start, F.lit(EXCERPT_BYTES)).alias("excerpt")).orderBy("draw").limit(
        2 * wanted * len(counts)).collect()
    parts: dict[str, list[bytes]] = {}
    for r in sample:
        parts.setdefault(r["lang"], []).append(letters(r["excerpt"]))
    return [(lang, b" ".join(parts.get(lang, []))[:room]) for lang, _ in counts if parts.get(lang)]


def sizes(text: bytes, compressors: list) -> np.ndarray:
    """Compressed size of the whole text with each dictionary."""
    total = np.zeros(len(compressors), np.int64)
    for at in range(0, len(text), BLOCK):
        block = text[at:at + BLOCK]
        total += [len(c.compress(block)) for c in compressors]
    return total


def compressors(dictionaries: list[tuple[str, bytes]]) -> list:
    made = []
    for _, content in dictionaries:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(
            level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def judge(text: str, languages: list[str], tools: list) -> tuple[str, float, float]:
    """Language, score and margin of a text with letters.

    The margin is the advantage of the smallest over the next size, relative to it, and 1 for a short text; the
    score is the share of the language when each four bytes more halve the odds.
    """
    raw = letters(text)
    total = sizes(raw, tools)
    order = np.argsort(total, kind="stable")
    best = total[order[0]]
    if len(order) == 1:
        return languages[0], 1.0, 1.0
    margin = float(total[order[1]] - best) / float(total[order[1]])
    if len(raw) < SURE_BYTES:
        margin = 1.0
    odds = np.exp2(-np.minimum((total - best) / 4.0, 60.0))
    return languages[order[0]], float(1.0 / odds.sum()), margin


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected; the dictionaries travel with the tasks."""
    names = ("lang_pred", "score", "margin", "rejected")
    languages = [lang for lang, _ in dictionaries]
    at = docs.columns.index(text_col)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(dictionaries)
        for batch in batches:
            found = []
            for text in batch.column(at):
                text = text.as_py()
                if text is None or not tools or not any(map(str.isalpha, text)):
                    found.append((UNKNOWN, 0.0, 0.0, True))
                else:
                    lang, score, gap = judge(text, languages, tools)
                    found.append((lang, score, gap, gap < margin))
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(
                (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def training(docs: DataFrame, id_col: str = "doc_id") -> Column:
    return common.remainder(F.col(id_col), 4) != 2


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected), one row per document."""
    held_out = ~training(docs, id_col)
    dictionaries = train(docs.where(~held_out), id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return identify(slim, dictionaries).drop("text")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is clear, with all their columns."""
    dictionaries = train(docs.where(training(docs, id_col)), id_col, text_col, lang_col)
    judged = identify(common.plain(docs), dictionaries, common.plain_name(docs, text_col))
    return judged.where("not rejected").drop("lang_pred", "score", "margin", "rejected").toDF(*docs.columns)
