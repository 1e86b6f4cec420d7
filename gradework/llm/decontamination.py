"""Operator 6: benchmark decontamination with a BM25 inverted index and block-max pruning.

Every document is read as overlapping passages, each long enough to hold any test item whole.  A
passage is a query of its distinct words; an item's score is the BM25 weight of the words found over
that of all its words, and an item's threshold is the least score that a passage can have which holds
``MIN_OVERLAP`` of its word shingles (what the heaviest words that may then be missing leave over).
Scores are divided by thresholds, so one threshold, 1, holds for all.

The items lie in blocks; for a term and a block the index has the largest score that the term gives an
item there.  A passage scores a block's postings only if the sum of those maxima reaches 1, so blocks
are skipped as block-max WAND skips them, here for all passages of a batch at once.  All items above
the threshold are retrieved and then verified by shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chain, documents, fresh, word_hashes

SHINGLE = 5
MIN_OVERLAP = 0.8
#: Items of one index, which goes to every task; more items are searched for in several such sets.
SET_ITEMS = 20_000
BLOCKS = 32
K1, B = 1.2, 0.75

_HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("overlap", T.DoubleType()),
            T.StructField("answer_overlap", T.DoubleType()),
            T.StructField("passages", T.LongType()),
        ]
    )
)


class ItemIndex:
    """Blocked postings of test items, and their shingles."""

    def __init__(self, ids: list[int], texts: list[str], answers: list[str | None]):
        words, at = word_hashes(pc.utf8_lower(pa.array(texts, pa.string())))
        keep = [i for i in range(len(ids)) if at[i + 1] > at[i]]
        lists = [words[at[i] : at[i + 1]] for i in keep]
        self.ids = [ids[i] for i in keep]
        answer_words, answer_at = word_hashes(pc.utf8_lower(pa.array([answers[i] for i in keep], pa.string())))
        self.answers = [answer_words[answer_at[i] : answer_at[i + 1]] if answers[k] else w[-SHINGLE:] for i, (k, w) in enumerate(zip(keep, lists))]
        self.shingles = [np.unique(chain(w, min(SHINGLE, len(w)))) for w in lists]
        self.widths = [min(SHINGLE, len(w)) for w in lists]
        n = len(lists)
        self.longest = max([len(x) for x in lists], default=1)
        self.vocabulary = np.unique(np.concatenate(lists)) if n else np.zeros(0, np.uint64)
        terms, items, tfs = [], [], []
        for i, w in enumerate(lists):
            t, c = np.unique(np.searchsorted(self.vocabulary, w), return_counts=True)
            terms.append(t)
            tfs.append(c)
            items.append(np.full(len(t), i))
        terms, items, tfs = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (terms, items, tfs))
        size = len(self.vocabulary)
        df = np.bincount(terms, minlength=size)
        lengths = np.array([len(x) for x in lists], dtype=np.float64)
        norm = K1 * (1 - B + B * lengths / (lengths.mean() if n else 1.0))
        weight = np.log1p((n - df[terms] + 0.5) / (df[terms] + 0.5)) * tfs * (K1 + 1) / (tfs + norm[items])
        weight /= np.bincount(items, weight, n)[items] if n else 1
        threshold = np.ones(n)
        for i, w in enumerate(lists):
            missing = int((1 - MIN_OVERLAP) * len(self.shingles[i]) + 1e-9)
            heaviest = np.sort(weight[slice(*np.searchsorted(items, [i, i + 1]))])[::-1]
            threshold[i] = max(1e-6, 1 - heaviest[:missing].sum() - 1e-9)
        weight /= threshold[items] if n else 1
        self.thresholds = threshold
        self.block_size = max(1, -(-n // BLOCKS))
        order = np.lexsort((items, terms))
        self.items, self.weights = items[order], weight[order]
        blocks = self.items // self.block_size
        self.at = np.searchsorted(terms[order] * BLOCKS + blocks, np.arange(size * BLOCKS + 1))
        self.maxima = np.zeros((size, BLOCKS), dtype=np.float32)
        np.maximum.at(self.maxima, (terms[order], blocks), self.weights.astype(np.float32))
        self.likely = np.zeros(1 << 20, dtype=bool)
        self.likely[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, texts: pa.Array) -> list[list[dict]]:
        """The verified items of every text."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not self.ids or not len(texts):
            return out
        words, at = word_hashes(pc.utf8_lower(texts))
        where = np.flatnonzero(self.likely[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        terms = np.searchsorted(self.vocabulary, words[where])
        same = self.vocabulary[np.minimum(terms, len(self.vocabulary) - 1)] == words[where]
        where, terms = where[same], terms[same]
        # Passage k of a text has the words from k to k + 2 strides; word p lies in passages p // stride and the one before.
        stride = max(64, self.longest)
        counts = np.diff(at)
        first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-counts // stride)))])
        text_of = np.searchsorted(at, where, side="right") - 1
        place = (where - at[text_of]) // stride
        passage = first[text_of] + place
        both = np.concatenate([passage, passage[place > 0] - 1])
        keys = np.unique(both * len(self.vocabulary) + np.concatenate([terms, terms[place > 0]]))
        passages, terms = keys // len(self.vocabulary), keys % len(self.vocabulary)
        starts = np.flatnonzero(np.concatenate([[True], passages[1:] != passages[:-1]])) if len(keys) else np.zeros(0, np.int64)
        best: dict[tuple[int, int], list] = {}
        for low in range(0, len(starts), 4096):
            here = starts[low : low + 4096]
            end = starts[low + 4096] if low + 4096 < len(starts) else len(keys)
            bounds = np.add.reduceat(self.maxima[terms[here[0] : end]], here - here[0], axis=0)
            which, block = np.nonzero(bounds >= 0.9999)
            if not len(which):
                continue
            ends = np.append(here[1:], end)
            sizes = (ends - here)[which]
            pair = np.repeat(np.arange(len(which)), sizes)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cell = terms[here[which][pair] + within] * BLOCKS + block[pair]
            a, n = self.at[cell], self.at[cell + 1] - self.at[cell]
            posting = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            scored = np.repeat(which[pair], n).astype(np.int64) * len(self.ids) + self.items[posting]
            found, inverse = np.unique(scored, return_inverse=True)
            score = np.bincount(inverse, self.weights[posting])
            for k in np.flatnonzero(score >= 1 - 1e-6):
                window, item = divmod(int(found[k]), len(self.ids))
                p = int(passages[here[window]])
                text = int(np.searchsorted(first, p, side="right")) - 1
                begin = at[text] + (p - first[text]) * stride
                self._verify(words[begin : min(at[text + 1], begin + 2 * stride)], text, item, float(score[k]), best)
        for (text, item), (score, overlap, answer, n) in sorted(best.items()):
            out[text].append({"item_id": self.ids[item], "score": score, "overlap": overlap, "answer_overlap": answer, "passages": n})
        return out

    def _verify(self, words: np.ndarray, text: int, item: int, score: float, best: dict) -> None:
        own = self.shingles[item]
        overlap = float(np.isin(own, chain(words, self.widths[item])).mean())
        if overlap + 1e-9 < MIN_OVERLAP:
            return
        answer = float(np.isin(self.answers[item], words).mean()) if len(self.answers[item]) else 1.0
        score *= float(self.thresholds[item])
        old = best.get((text, item), [0.0, 0.0, 0.0, 0])
        best[text, item] = [max(old[0], score), max(old[1], overlap), max(old[2], answer), old[3] + 1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", set_items: int = SET_ITEMS) -> DataFrame:
    """``docs`` with an array of (item_id, score, overlap, answer_overlap, passages): the test items that a text holds.

    benchmark has item_id and text, and may have answer; an answer must then lie in the passage too (half
    of its words).  Null and empty texts, in either table, leak nothing; repeated rows are rows of their
    own; with an empty benchmark the arrays are empty; a column of ``docs`` named ``column`` is replaced.
    """
    docs = docs.drop(column)
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text", answer.alias("answer"))
    sets = max(1, -(-items.count() // set_items))
    wanted = "answer" in benchmark.columns
    for k in range(sets):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == k).collect()
        rows.sort(key=lambda r: (r["item_id"], r["text"]))
        index = docs.sparkSession.sparkContext.broadcast([[r[i] for r in rows] for i in range(3)])
        docs = _search(docs, index, column, wanted)
    return docs


def _search(docs: DataFrame, items, column: str, wanted: bool) -> DataFrame:
    again = column in docs.columns
    schema = docs.schema if again else T.StructType([*docs.schema.fields, T.StructField(column, _HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*items.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hits = index.hits(part.column(part.schema.get_field_index("text")))
                if wanted:
                    hits = [[h for h in x if h["answer_overlap"] >= 0.5] for x in hits]
                columns = list(part.columns)
                names = list(part.schema.names)
                if again:
                    k = names.index(column)
                    hits = [[*(old or []), *new] for old, new in zip(columns[k].to_pylist(), hits)]
                    columns.pop(k)
                    names.pop(k)
                made = pa.array(hits, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passages", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*columns, made], names=[*names, column])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts hold no test item; the cases are those of ``find_leaks``, and other columns stay, whatever their names."""
    leaks = fresh(docs, "_leaks")
    return find_leaks(docs, benchmark, leaks).filter(F.size(leaks) == 0).drop(leaks)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document and test item found in it: doc_id, item_id, score, overlap, answer_overlap, passages."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.inline("leaks"))


QUERIES = {"op6_decontamination": op6_decontamination}
