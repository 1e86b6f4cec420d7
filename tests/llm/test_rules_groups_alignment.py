"""Operators 11 to 13 against brute force, on small tables with nulls, empty and odd texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradework.llm import quality_rules as rules
from gradework.llm import spelling_groups as spelling
from gradework.llm import token_alignment as alignment

SCHEMA = "doc_id long, text string, lang string, word string, n long, shard long, pair long, _statistics string, _quality string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly boxed the jolly old king"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "w", 1, 2, 3, "s", "q") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    own = [PROSE, PROSE, None, "", " \n\n ", "a", "Été  garçon\nnaïve\t\tend\r\n x", "x" * 3000, "\n".join([PROSE] * 3), "tok " * 3000, "日本 語、テスト😀done " * 40, "日本語" * 900 + "abcXYZ123+/" * 300]
    own += ["a  b\n\nc \t<s> é\u0000 <|endoftext|> </s> <0x41>", "a▁b", "  lead trail  ", " ", "a  b　c", "### $$$ |x| <y> *z* 50% a&b", "a b a b a b a b a b a b", "WHO SAID IT WAS AN ODD DAY ON A BIG SHIP"]
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    return [*((10_000 + k, t) for k, t in enumerate(own)), (10_000, PROSE), (None, "no id at all, but words"), *real]


def same(got, want):
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order)


# ---- 12


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_counts_of_rules(spark, rows):
    got = rules.measure(frame(spark, rows), column="_counts").select("doc_id", *(F.col(f"_counts.{c}") for c in rules._COUNTS[:5])).collect()
    same(got, [(i, *counted(t)) for i, t in rows])


def test_counts_are_alike_in_slices(monkeypatch, rows):
    texts = pa.array([t for _, t in rows])
    whole = rules.statistics(texts).to_pylist()
    monkeypatch.setattr(rules, "_SLICE", 50)
    assert rules.statistics(texts).to_pylist() == whole


def test_statistics_of_very_long_text(spark):
    text = "\n".join(f"line {k % 5000} has its own words {k}" for k in range(120_000))
    assert tuple(rules.statistics(pa.array([text])).to_pylist()[0].values())[:5] == counted(text)


def test_covering_finds_planted_conjunctions():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(rules.FEATURES)))
    bad = ((x[:, 2] > 0.7) & (x[:, 5] < 0.4)) | (x[:, 9] > 0.9)
    found = rules.cover(x, bad, np.arange(4000) % 3 != 0)
    fresh = rng.random((4000, len(rules.FEATURES)))
    truth = ((fresh[:, 2] > 0.7) & (fresh[:, 5] < 0.4)) | (fresh[:, 9] > 0.9)
    told = np.any([rules.covers(r, fresh) for r in found], axis=0)
    assert (told == truth).mean() > 0.97
    assert {c.feature for r in found for c in r} >= {rules.FEATURES[2], rules.FEATURES[5], rules.FEATURES[9]}


def test_pruning_drops_what_does_not_pay():
    rule = (rules.Condition(rules.FEATURES[0], True, 0.5), rules.Condition(rules.FEATURES[1], True, 0.5))
    x = np.zeros((4, len(rules.FEATURES)))
    x[:, 0] = [0.9, 0.9, 0.1, 0.1]
    assert rules.prune(rule, x, np.array([True, True, False, False])) == rule[:1]


def test_one_kind_of_label_gives_no_rule(spark, rows):
    docs = frame(spark, rows)
    for labels in ([(1, 1, 0), (2, 1, 0), (3, None, 0)], []):
        assert rules.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == []
    kept = rules.judge(docs, []).filter("_quality.kept")
    assert kept.count() == sum(n >= 10 and 100 * again <= 20 * n for n, _, _, _, again in (counted(t) for _, t in rows))
    assert rules.judge(docs.limit(0), []).count() == 0


def test_verdicts_are_those_of_the_stated_rules(spark, rows):
    docs = frame(spark, rows)
    found = [(rules.Condition("symbols_per_word", True, 0.2),), (rules.Condition("upper_share", True, 0.5), rules.Condition("chars_per_word", False, 6.0))]
    stats = rules.measure(docs, column="_s")
    table = np.array([list(r) for r in stats.select(*(c.alias(n) for n, c in rules.features("_s").items())).collect()], dtype=float)
    first = [next((k + 1 for k, r in enumerate(found) if rules.covers(r, row[None])[0]), None) for row in table]
    judged = rules.judge(docs, found, column="_verdict").select("_verdict.*", "_quality", "text").collect()
    assert [r["rule"] for r in judged] == first and {1, 2, None} == set(first)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] is None) for r in judged) and {r["_quality"] for r in judged} == {"q"}


def test_quality_query_keeps_clean_documents(spark, sf_dir):
    held = "crc32(cast(doc_id as string)) % 3 = 1"
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    found = rules.learn(docs, labels.filter(f"not ({held})"))
    told = rules.judge(docs.join(labels.filter(held), "doc_id"), found).select("quality", "_quality.kept", "_quality.base_failed").collect()
    clean = [r for r in told if r["quality"] == 1 and not r["base_failed"]]
    poor = [r for r in told if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean) and sum(not r["kept"] for r in poor) >= 0.9 * len(poor)
    out = rules.op12_quality_rules(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and out.columns[-3:] == ["base_failed", "kept", "rule"]


# ---- 13


def brute_groups(rows, least=5, shortest=6, ratio=5):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= shortest
    n = {w: c for w, c in count.items() if c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    out, form = [], {}
    for w in n:
        around = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if x != w and near(w, x)]
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out.append((w, n[w], len(around)))
    roots = {}
    for w in n:
        roots[w] = w
        while form[roots[w]]:
            roots[w] = form[roots[w]]
    return [(w, form[w], roots[w], c, k, n[form[w]] if form[w] else None) for w, c, k in out]


def test_spelling_groups_of_documents(spark, rows):
    same(spelling.spelling_groups(frame(spark, rows)).collect(), brute_groups(rows))


def test_spelling_groups_of_planted_variants(spark):
    rng = random.Random(3)
    roots = ["".join(rng.choice("abcdeé÷") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    texts = []
    for k in range(900):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(roots)
            for _ in range(rng.choice((0,) * 60 + (1,) * 10 + (2, 2))):  # chains of variants
                at, c = rng.randrange(len(w)), rng.choice("abÉ")
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]))
            words.append(rng.choice((w, w.upper() if w.isascii() else w)))
        texts.append((k, rng.choice(" ,-3_ß") .join(words)))
    texts.append((None, "aabbccdd " * 900))
    texts += [(5000 + k, f"{w} " * n) for k, (w, n) in enumerate((("zyxwvu", 900), ("zyxwvt", 150), ("zyxwst", 25), ("zyxrst", 5)))]
    want = brute_groups(texts)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    same(spelling.spelling_groups(frame(spark, texts)).collect(), want)


def test_spelling_groups_follow_long_chains(spark):
    chain = [("abcdef" + "x" * k, 5 ** (9 - k)) for k in range(9)]
    formed = spelling.forms(spark.createDataFrame(chain, "word string, n long"))
    assert {r["root"] for r in spelling.with_roots(formed).collect()} == {"abcdef"}


def test_spelling_groups_of_nothing(spark):
    assert spelling.spelling_groups(frame(spark, [(1, None), (2, ""), (3, "tiny words")])).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, None)]).limit(0)).count() == 0


# ---- 11


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    code = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    a_bytes = {k: bytes(code[c] for c in t) for t, k in a.get_vocab().items() if set(t) <= set(code)}

    def b_bytes(k):
        name = b.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if b.is_byte(k) else name.replace("▁", " ").encode()

    def tokens(text):
        """(ids, byte ends) of both, or None."""
        if not text:
            return None
        out = []
        for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, a_bytes.__getitem__), (b.encode(text), b_bytes)):
            parts = [of(k) for k in ids]
            if b"".join(parts) != b" " + text.encode():
                return None
            out.append((ids, np.cumsum([len(p) for p in parts]).tolist()))
        return out

    return tokens


def brute_alignment(rows, tokens):
    found = []
    for _, text in rows:
        groups = []
        if (t := tokens(text)) is not None:
            ends = sorted(set(t[0][1]) & set(t[1][1]))
            groups = [tuple([k for k, e in zip(ids, at) if begin < e <= end] for ids, at in t) for begin, end in zip([0, *ends], ends)] if len(ends) < 4000 else walked(t, ends)
        found.append(groups)
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in found]
    count = collections.Counter(p for own in links for p in set(own))
    highest = collections.defaultdict(int)
    for (x, _), c in count.items():
        highest[x] = max(highest[x], c)
    for (i, _), groups, own in zip(rows, found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own),
            sum(count[p] == highest[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


def walked(tokens, ends):
    at, out = [0, 0], []
    for end in ends:
        group = ([], [])
        for side in (0, 1):
            while at[side] < len(tokens[side][1]) and tokens[side][1][at[side]] <= end:
                group[side].append(tokens[side][0][at[side]])
                at[side] += 1
        out.append(group)
    return out


def test_alignment_of_documents(spark, rows, paths, both):
    same(alignment.align_corpus(frame(spark, rows), *paths).collect(), brute_alignment(rows, both))


def test_alignment_of_fuzzed_texts(spark, paths, both, monkeypatch):
    rng = random.Random(7)
    signs = list("aA1 .,\n\t\r' '-_▁éßİ़ा日😀 ‍") + ["  ", "\n ", "the", " of", "<s>", "\u0000", "ﬁ", "▁x", "क्ष", "’s", "000000"]
    texts = [(k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for k in range(600)]
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    monkeypatch.setattr(alignment, "SHARD_DOCS", 50)
    same(alignment.align_corpus(frame(spark, texts), *paths).collect(), brute_alignment(texts, both))


def test_cuts_by_look_up_and_by_sort(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        ends = sorted(rng.sample(range(1, 900), rng.randint(1, 300)))
        rows.append((ends, sorted(rng.sample(ends, rng.randint(0, len(ends))))))
    df = spark.createDataFrame(rows, "ends array<int>, shared array<int>")
    got = df.withColumn("at", F.transform(F.array(F.struct("ends", "shared")), lambda x: alignment.cuts(x["ends"], x["shared"]))[0]).collect()
    assert any(len(r["shared"]) > alignment.FEW for r in got) and any(0 < len(r["shared"]) <= alignment.FEW for r in got)
    assert all(r["at"] == [r["ends"].index(e) + 1 for e in r["shared"]] for r in got)


def test_alignment_of_a_text_without_blanks(spark, paths, both):
    text = [(1, "".join(random.Random(2).choice("abcdefXYZ0189+/日é") for _ in range(60_000)))]
    same(alignment.align_corpus(frame(spark, text), *paths).collect(), brute_alignment(text, both))


def test_alignment_of_nothing(spark, paths):
    assert alignment.align_corpus(frame(spark, [(1, "x")]).limit(0), *paths).count() == 0
    assert [tuple(r) for r in alignment.align_corpus(frame(spark, [(1, None), (1, "")]), *paths).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


# ---- earlier operators


@pytest.mark.parametrize("name, drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_letters_that_normalise_to_letter_and_mark(name, drops):
    import unicodedata

    import public_tokenizers

    from gradework.llm import tokens

    enc = tokens.Encoder(public_tokenizers.path(name), drops, 4)
    letters = [chr(c) for c in range(0x3000) if chr(c).isalpha()] + [chr(c) for c in range(0xF900, 0xFFE0) if chr(c).isalpha()]
    odd = [c for c in letters if len(unicodedata.normalize("NFC", c).lower()) != 1]
    assert "İ" in odd and len(odd) > 30
    rng = random.Random(4)
    pool = rng.sample(letters, 300) + odd + list(".,\n aA1_'-") * 20
    texts = [f"x{c}. {c}, {c}\nb a\n{c}.5" for c in [*odd, *letters[::5]]] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 20))) for _ in range(2000)]
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_leaks_replace_a_column_of_their_name(spark, rows):
    from gradework.llm import decontamination

    docs = frame(spark, [(1, PROSE), (2, None)]).withColumn("leaks", F.lit("mine"))
    items = spark.createDataFrame([(5, PROSE)], "item_id long, text string")
    found = {r["doc_id"]: [h["item_id"] for h in r["leaks"]] for r in decontamination.find_leaks(docs, items).collect()}
    assert found == {1: [5], 2: []}
