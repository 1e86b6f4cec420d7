"""Operator 10: language identification by compression.

Each language has a raw-content zstandard dictionary made of its own training texts.  A text is
compressed with each, in pieces of ``PIECE_BYTES`` that know nothing of each other, so that what a
dictionary saves grows with the text and the margin does not depend on its length; the language whose dictionary gives the fewest bytes wins, and the text is
rejected when the runner-up is nearly as small.  Case, digits and signs are folded away before, as they
say nothing of a language.

Bound: the dictionaries are learned from at most ``MAX_SAMPLE_DOCS`` labelled documents a language and
hold at most ``DICTIONARY_BYTES`` bytes each (a documented sample of labelled rows).  Every document is
scored over its whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, documents

DICTIONARY_BYTES = 96 << 10
MAX_SAMPLE_DOCS = 200
#: At most this many bytes of a sample document go into a dictionary, so that no text fills it alone.
MAX_DOC_BYTES = 4096
LEVEL = 9
#: Longer texts are compressed in pieces of about so many bytes, which end where a word ends.
PIECE_BYTES = 16 << 10
#: Below this share of bytes saved against the runner-up a text is rejected, if it is long enough to show one.
MIN_MARGIN = 0.004
MARGIN_FROM_BYTES = 48

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def pieces(raw: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    """``raw`` in equal parts of at most ``size`` bytes, cut at the last space of a part if there is one."""
    if len(raw) <= size:
        return [raw]
    out, at = [], 0
    while at < len(raw):
        end = at + -(-(len(raw) - at) // -(-(len(raw) - at) // size))
        if end < len(raw):
            end = raw.rfind(b" ", at + 1, end) + 1 or end
        out.append(raw[at:end])
        at = end
    return out


def learn_dictionaries(labelled: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, max_docs: int = MAX_SAMPLE_DOCS) -> dict[str, bytes]:
    """language -> dictionary content, the commonest language first, from (text, lang, order) rows with neither null.

    A document's place in the sample is by the hash ``order``, so it depends on no partitioning.  Of a
    language with more documents, a share by hash is taken before ranking, so that few rows move.
    """
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    space = 1 << 20
    bound = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = min(space, math.ceil(space * min(1.0, (max_docs + 8 * math.sqrt(max_docs) + 20) / n)))
        bound = F.when(F.col("lang") == lang, F.lit(share)).otherwise(bound)
    rank = Window.partitionBy("lang").orderBy("order", "text")
    sample = (
        labelled.filter(F.pmod(F.col("order"), F.lit(space)) < bound)
        .select("lang", "order", F.substring("text", 1, MAX_DOC_BYTES).alias("text"))
        .withColumn("nth", F.row_number().over(rank))
        .filter(F.col("nth") <= max_docs)
        .collect()
    )
    out = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        # zstandard finds what lies near the end of a dictionary most cheaply; the order is arbitrary here.
        parts, room = [], dictionary_bytes
        for row in sorted((r for r in sample if r["lang"] == lang), key=lambda r: r["nth"]):
            content = folded(row["text"])[: min(MAX_DOC_BYTES, room)]
            parts.append(content)
            room -= len(content)
            if room <= 0:
                break
        out[lang] = b"\n".join(parts)
    return {k: v for k, v in out.items() if len(v) >= 8}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = LEVEL, column: str = "_language") -> DataFrame:
    """``docs`` with ``column``, a struct of lang_pred, score and rejected.

    lang_pred is ``und`` (score 0, rejected) where the text is null or has no letter, or where no
    language was learned.  score is the winner's share of two-to-the-bits-saved over all languages, with
    bits scaled to a whole text, from 0 to 1.  Ties go to the language that comes first in ``dictionaries``.
    Repeated rows, and rows without doc_id, are told like others; an empty table gives no rows; other columns stay.
    Texts of fewer than ``MARGIN_FROM_BYTES`` folded bytes are never rejected for a narrow margin.
    """
    languages = list(dictionaries)
    content = [dictionaries[x] for x in languages]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        packers = []
        for c in content:
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packers.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for texts in batches:
            rows = []
            for x in texts:
                if x is None or not packers or not _LETTER.search(x):
                    rows.append((UNDETERMINED, 0.0, True))
                    continue
                raw = folded(x)
                parts = pieces(raw)
                sizes = [sum(len(p.compress(part)) for part in parts) for p in packers]
                best = min(sizes)
                order = sorted(sizes)
                gap = order[1] - best if len(order) > 1 else len(raw)
                score = 1.0 / sum(2.0 ** -min(60.0, (s - best) / 2) for s in sizes)
                narrow = len(raw) >= MARGIN_FROM_BYTES and gap < MIN_MARGIN * best
                rows.append((languages[sizes.index(best)], score, narrow))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    predict = F.pandas_udf(run, "lang_pred string, score double, rejected boolean")
    return docs.withColumn(column, predict(F.col(text)))


def train(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the text and lang of those documents whose crc32(doc_id) mod 4 is not 2."""
    labelled = docs.filter(crc_mod("doc_id", 4) != 2).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return learn_dictionaries(labelled.select("text", "lang", F.xxhash64("doc_id").alias("order")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    docs = documents(spark, sf_dir)
    predicted = identify(docs.select("doc_id", "text"), train(docs))
    return predicted.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "_language.*")


QUERIES = {"op10_language_id": op10_language_id}
