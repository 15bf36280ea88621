"""Each training-data operator against a brute-force version on a small table with nulls, empties, copies and clashing columns."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.llm import common, decontaminate, exact_topk, lang_id, license_scan, ngram_join, packing, pii, pitman_yor, token_output, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, node string, row string, hash string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus() -> list[tuple]:
    rng = random.Random(3)
    syllables = {"en": ["the", "and", "tion", "er", "wh"], "de": ["ung", "sch", "ein", "über", "ß"]}
    texts = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        texts.append((lang, " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))) + ".\nThe End"))
    base = texts[0][1].split()
    for i in range(0, 24):  # near copies, some of which link only through others
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(len(copy))] = "changed" + str(rng.randint(0, 9))
        texts.append(("en", " ".join(copy)))
    texts += [("en", texts[1][1])] * 3
    texts += [("en", "mail a.b@x.example.org, call +44 20 7946 0958 or 4111 1111 1111 1111 from 10.0.0.300 and 10.0.0.3.")]
    texts += [("en", "Released under the MIT License. The Apache Licence; licensed under the Apache License, Version 2.0. GNU General Public License mit license mit license")]
    texts += [("en", "IBAN GB82 WEST 1234 5698 7654 32 and é é 5.5.5.5"), (None, None), ("en", ""), ("en", "  \t\n "), ("en", "123 456"), ("de", "x"), ("en", "one two three"), ("en", "one <|endoftext|> two<|endoftext|>")]
    rows = [(i, t, lang, "s", 0, "w", "n", "r", "h") for i, (lang, t) in enumerate(texts)]
    return [*rows, rows[5], (None, "a row without an id " * 9, "en", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@functools.cache
def plain_tokenizer():
    """The library as it is, apart from the operators' encoder."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text: str | None) -> np.ndarray:
    made = plain_tokenizer().encode(text or "", add_special_tokens=False).ids
    return np.asarray([*made, 0], "<u4")


def test_encoder_equals_library():
    odd = ["", " ", "a  b", "\n\nx y\n z", "hi<|endoftext|> there", "a\tb c", "it's 'y don't.", "é\xa0b c", "a \n b", "1 2  3\n", "\n", " a b", "a\x1cb c", "x. y, z.. É ñandú", "word" * 5000]
    coder = tokens.Encoder(most=4)
    for text in odd * 2:
        assert coder.batch([text])[0] == ids_of(text)[:-1].tobytes()
    assert ids_of("hi<|endoftext|> there").tolist() == [5303, 50256, 612, 0]


def test_encoder_looks_up_each_run_once():
    class Counted(tokens.Runs):
        asked, encoded = 0, []

        def __getitem__(self, run):
            self.asked += 1
            return super().__getitem__(run)

        def encode(self, text):
            self.encoded.append(text)
            return super().encode(text)

    coder = tokens.Encoder()
    coder.runs = Counted(coder.tokenizer)
    texts = [f"ein Wörtchen!! and one {i % 3}\nand é%%% one, zwei" for i in range(200)]
    assert coder.batch(texts) == [ids_of(x)[:-1].tobytes() for x in texts]
    assert coder.runs.asked <= 20  # 1,600 runs, 11 of them distinct, 3 of these also without their marks
    assert sorted(coder.runs.encoded) == ["\n", " 0", " 1", " 2", "!!", "%%%", ","]  # words with marks are not encoded whole


def test_encoder_takes_texts_together():
    rng = random.Random(11)
    marks = ["", "", ".", ",", "!!", "'", "''", "'s", "_", "%%%%%", ").", "-", "[~]", "\u00d7", "\u2026", "\u0301", "\x00", "9", "@a"]
    words = ["It", "don't", "é", "Ñandú", "x", "HATI", "3.5", "a_b", "日本", "l'", "ß", "_"]
    texts = []
    for _ in range(300):
        runs = [rng.choice(words) + rng.choice(marks) + rng.choice(marks) for _ in range(rng.randint(0, 30))]
        texts.append("".join(x for run in runs for x in (run, rng.choice(["\n", *[" "] * 6, *["  "] * (rng.random() < 0.02)])))[: rng.choice([-1, None])])
    texts += ["", "", "one<|endoftext|> two", "word " * 40 + "end", "\U0001f600 a\n\U0001f600"]
    want = [ids_of(x)[:-1].tobytes() for x in texts]
    for most, chars in ((1_000_000, 4_000_000), (4, 4_000_000), (50, 100), (1_000_000, 0)):
        assert tokens.Encoder(most=most).batch(texts, chars) == want
    assert tokens.Encoder().batch([]) == [] and tokens.Encoder().batch([""]) == [b""]


@pytest.mark.parametrize("ids", [[], [5], [2**32 - 1, 7, 7], list(range(2000)), [1] * 5000])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (token_output.decode_block(*token_output.encode_block(ids), len(ids)) == ids).all()


def test_simple8b_large_values():
    codes = np.array([0, 1, 2**59, 3, 2**30, 2**60 - 1] * 300, np.uint64)
    bits = np.array([max(1, int(c).bit_length()) for c in codes], np.uint8)
    words, sizes = token_output.pack(codes, bits)
    assert (token_output.unpack(words, sizes, len(codes)) == codes).all()


def test_token_output(spark, docs, empty):
    found = token_output.token_table(spark, docs).orderBy(F.col("start")).collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    at = 0
    for got, row in zip(found, rows, strict=True):
        ids = ids_of(row[1])
        assert (got.start, got.n_tokens, got.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_output.token_table(spark, empty).count() == 0


def test_read_ids(spark, docs, tmp_path):
    token_output.write_tokens(docs, f"file://{tmp_path}/t", block_ids=100)
    found = {r.doc_id: list(r.ids) for r in token_output.read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).collect()}
    assert all(found[r[0]] == ids_of(r[1]).tolist() for r in corpus())


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, epoch=8).collect()
    whole = {r[0]: ids_of(r[1]) for r in corpus()}
    assert all(zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id]) for r in rows)
    assert sum(r.length for r in rows) == sum(len(ids_of(r[1])) for r in corpus())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.length for r in pieces))
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 1024
        sizes.append(ends[-1])
    assert sum(s & (s - 1) != 0 for s in sizes) <= docs.rdd.getNumPartitions()
    assert packing.pack_documents(empty).count() == 0


def test_packer_fills_windows():
    pieces = []
    packer = packing.Packer(0, (1024, 512, 256, 128), 8192, pieces.append)
    rng = random.Random(1)
    sizes = [rng.randint(1, 3000) for _ in range(300)]
    for i, n in enumerate(sizes):
        packer.add(i, b"\1\0\0\0" * n)
    packer.pack(last=True)
    held = Counter()
    for _, _, n, _, _, sequence, *_ in pieces:
        held[sequence] += n
    assert sum(held.values()) == sum(sizes)
    assert sum(s not in (1024, 512, 256, 128) for s in held.values()) <= 1


def test_license_scan(docs, empty):
    found = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert license_scan.scan(docs).count() == len(corpus()) and license_scan.scan(empty).count() == 0
    for row in corpus():
        words = WORD.findall((row[1] or "").translate(LOW))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        r = found[row[0]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_template_with_a_changed_word(spark):
    text = "permission is hereby granted free of charge to any lucky person obtaining a copy of this software and associated documentation files"
    row = license_scan.scan(spark.createDataFrame([(1, text), (2, "permission is granted")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert row[0].labels == "mit" and row[0].base_labels == "" and 0.8 <= row[0].score < 1
    assert row[1].labels == "" and row[1].score == 0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text: str) -> str:
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii(spark, docs, empty):
    tricky = ["a@b.c_x@y.z.w", "@", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "+1 (212) 555-0100+442079460958", "0000000000001.2.3.4", "𝒳 x@y.zz 4111-1111-1111-1111 1", "1" * 5000, "a" * 5000 + "@" + "b." * 3000 + "c", "+1()1 4111111111111111 4111111111111112"]
    rng = random.Random(2)
    tricky += ["".join(rng.choices("01.2@+- ()ax_%é😀", k=60)) for _ in range(200)]
    rows = [*((r[0], r[1]) for r in corpus()), *((1000 + i, t) for i, t in enumerate(tricky))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for got in pii.scan(table).collect():
        text = next(t for d, t in rows if d == got.doc_id) or ""
        assert got.base_sha256 == hashlib.sha256(personal(text).encode()).hexdigest(), text
        assert got.spans.startswith(personal(text))
    assert pii.scan(docs).count() == len(corpus()) and pii.scan(empty).count() == 0
    iban = next(r for r in pii.scan(docs).collect() if r.n_iban)
    assert iban.spans.split(",")[-1] == "iban:5:32"


def test_redact(docs):
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(corpus())
    text = clean.where("text like 'mail%'").first().text
    assert text == "mail [EMAIL], call [PHONE] or [CARD] from 10.0.0.300 and [IP]."
    assert clean.where("text is null").count() == 1


def test_exact_topk(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 6)).round(1)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    rows += [(3000, None, "x", 1), (3100, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x", 1), (3200, [float("nan")] * 6, "x", 1), (3300, [1.0], "x", 1), (None, [1.0] * 6, "x", 1), (3400, [float("inf")] * 6, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, n int").repartition(3)
    found = exact_topk.top_k(table, table.where("vec_id % 100 = 0"), k=7, block=500, query_block=8).collect()
    exact = np.floor(1024 * vectors).astype(np.int64)
    scores = exact @ exact.T
    want = set()
    for q in range(0, 3000, 100):
        order = [i for i in np.lexsort((np.arange(3000), -scores[q])) if i != q][:7]
        want |= {(q, n + 1, int(i), int(scores[q, i])) for n, i in enumerate(order)}
    assert {tuple(r) for r in found} == want
    assert exact_topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_exact_topk_with_repeated_query_ids(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 16)).round(2)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids = np.array([0] * 20 + list(range(20, 300)))
    vectors[:20] = vectors[0]
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    exact = np.floor(1024 * vectors).astype(np.int64)
    found = exact_topk.top_k(table, table.where("vec_id in (0, 50)"), k=7, block=300).collect()
    want = Counter()
    for q, copies in ((0, 20), (50, 1)):
        scores = exact @ exact[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:7]
        for n, i in enumerate(order):
            want[(q, n + 1, int(ids[i]), int(scores[i]))] += copies
    assert Counter(tuple(r) for r in found) == want


def test_decontaminate(spark, docs, empty):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))) for i, n in enumerate((5, 14, 30, 60, 3))]
    items += [(9, None), (10, ""), (11, items[3][1])]
    long = "before " * 30
    edited = items[3][1].split()
    edited[0] = "other"
    texts = [(1, long + items[1][1].upper() + " after"), (2, items[2][1]), (3, long), (4, None), (5, ""), (6, " ".join(edited) + " " + long), (7, " ".join(items[3][1].split()[:20])), (8, items[4][1]), (8, items[0][1] + "! " + items[0][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, finger string")
    table = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, window int")

    def shingles(t):
        w = WORD.findall((t or "").translate(LOW))
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    want = {}
    for (d, t), (i, item) in itertools.product(texts, items):
        a, b = shingles(t), Counter(shingles(item))
        n = sum(b.values())
        for s in range(max(1, len(a) - n + 1)):
            w = Counter(a[s : s + n])
            shared = sum((w & b).values())
            if n and shared / (sum(w.values()) + n - shared) >= 0.8:
                want[d, i] = max(want.get((d, i), 0), round(shared / (sum(w.values()) + n - shared), 6))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(table, bench).collect()}
    assert found == want and (6, 3) in want
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(table, bench.limit(0)).count() == 0
    assert decontaminate.find(docs, bench).count() == 0


def test_decontaminate_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 5)
    bench = spark.createDataFrame([(i, " ".join(f"a{i}b{j}" for j in range(12))) for i in range(4)], "item_id long, text string")
    found = decontaminate.find(bench.select(F.col("item_id").alias("doc_id"), "text"), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(4)}


def linked(rows: list[tuple], k: int, percent: int) -> dict:
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in groups.items()}
    return Counter((d, len(s), least[root(i)] if s else d) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent", "rare"), [(4, 85, 64), (5, 80, 4)])
def test_ngram_join(docs, empty, k, percent, rare):
    found = ngram_join.join(docs, k, percent, rare)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == linked([(r[0], r[1]) for r in corpus()], k, percent)
    if rare == 4:
        assert ngram_join.join(empty, k, percent).count() == 0


def test_crowded_near_copies(spark):
    """Many copies of one text, each changed in a few places: links, chains and misses among thousands of pairs."""
    rng = random.Random(8)
    base = [f"b{rng.randint(0, 5000)}" for _ in range(160)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"c{i}x{rng.randint(0, 99)}"
        rows.append((i, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ngram_join.join(table, 4, 85, rare=8).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == linked(rows, 4, 85)


@pytest.mark.parametrize("rare", [64, 4])
def test_links_are_counted(spark, rare):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one two")]
    for group in range(3):
        base = [f"g{group}w{rng.randint(0, 300)}" for _ in range(150)]
        for i in range((5, 12, 25)[group]):
            copy = list(base)
            for _ in range(rng.randint(0, (0, 2, 4)[group])):
                copy[rng.randrange(len(copy))] = f"c{group}x{i}x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join([*copy, f"end{i}"])))
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    others = set(sets.values()) - {frozenset()}
    want = {d: sum(s != o and 100 * len(s & o) >= 85 * len(s | o) for o in others) if s else 0 for d, s in sets.items()}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join.join(table, 4, 85, rare=rare).collect()
    assert {r.doc_id: r.n_links for r in found} == want and [want[d] for d in range(4, 9)] == [4] * 5
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == linked(rows, 4, 85)


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(4)
    for percent, (trial) in itertools.product((80, 85), range(150)):
        n = int(rng.integers(1, 60))
        whole = rng.integers(0, 2**63, n + 10, dtype=np.int64).astype(np.uint64)
        classes = rng.integers(0, 12, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
        gone = int(rng.integers(0, max(1, n // 8) + 1))
        x, y = np.unique(whole[:n]), np.unique(np.concatenate([whole[gone:n], whole[n : n + int(rng.integers(0, 4))]]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both):
            for rare in (0, 3, 6, 12):
                a, b = (set(ngram_join.keys_of(s, classes, percent, rare)[0].tolist()) for s in (x, y))
                assert a & b, (percent, trial, rare)


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    want = linked([(r[0], r[1]) for r in corpus()], 5, 80)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns
    assert ids == Counter({d: 1 for d, n, c in want if d == c})


def test_flagged_ids(spark, docs):
    ids = spark.createDataFrame([(3,), (70,), (None,)], "doc_id long")
    left = Counter(r.doc_id for r in common.without_ids(docs, ids).collect())
    assert left == Counter(r[0] for r in corpus() if r[0] not in (3, 70, None))
    assert common.without_ids(docs, ids.limit(0)).count() == len(corpus())


def test_lang_id(spark, docs, empty):
    held = common.id_crc_mod("doc_id", 4) == 2
    model = lang_id.train(docs, ~held)
    rows = lang_id.classify(docs, model).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.lang_score <= 1 for r in rows)
    long = [r for r in rows if r.text and len(r.text) > 100 and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in long]) > 0.9
    assert all(r.lang_pred == "und" for r in rows if not re.search(r"[^\W\d_]", r.text or ""))
    assert lang_id.classify(docs, lang_id.train(empty, ~held)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert lang_id.classify(empty, model).count() == 0


def test_pitman_yor(docs, empty):
    small = pitman_yor.Options(block_tokens=500)
    rows = pitman_yor.score(docs, small).collect()
    texts = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in corpus()]
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode())
    counts = Counter(w for d, ws in texts if crc(d) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, crc(d) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and r.perplexity > 1 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert pitman_yor.score(empty).count() == 0


def test_pitman_yor_by_hand(spark, docs):
    """The model's probabilities from its seatings in plain Python: they sum to one, and make up the scores."""
    o = pitman_yor.Options(classes=4, least_contexts=16, most_contexts=16, burn=1, samples=2, apart=1)
    texts = {(r[0], r[1]): (r[1] or "").encode().lower().split() + [b"\n"] for r in corpus()}
    every = [(d, t, texts[d, t]) for d, t in ((r[0], r[1]) for r in corpus())]
    context = lambda w: pitman_yor.context_of(w, o, 16)
    number = {w: pitman_yor.xxhash.xxh3_64_intdigest(w) for ws in texts.values() for w in ws}
    counts = Counter((number[w], context(a)) for d, _, ws in every if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2 for a, w in zip([b"\n", *ws], ws, strict=False))
    keys = sorted(counts)
    known = sorted({w for w, _ in keys})
    arrays = [np.array(known, np.uint64), np.array([sum(w == x for x, _ in keys) for w in known]), np.array([u for _, u in keys]), np.array([counts[k] for k in keys])]
    part = pitman_yor.Part(arrays, o, 16)
    customers, states = Counter(), []
    for (_, u), n in counts.items():
        customers[u] += n
    for turn in range(3):
        sums = pitman_yor.Totals.of(part.vector().astype(float), o, 16)
        part.sweep(turn, sums, len(known))
        if turn:
            states.append(([dict(zip(keys, part.tables.tolist(), strict=True)), *(dict(zip([(known[w], c) for w, c in zip(part.group_word.tolist(), part.group_class.tolist(), strict=True)], x.tolist(), strict=True)) for x in (part.guests, part.group_tables)), *(dict(zip(known, x.tolist(), strict=True)) for x in (part.root, part.root_tables))]))

    def probability(state, w, u):
        tables, guests, group_tables, root, root_tables = state
        top = (o.root_strength + o.root_discount * sum(root_tables.values())) / (len(known) + 1)
        p = (root.get(w, 0) - o.root_discount * root_tables.get(w, 0) + top) / (o.root_strength + sum(root.values()))
        c = u // 4
        in_class = sum(v for (_, x), v in guests.items() if x == c), sum(v for (_, x), v in group_tables.items() if x == c)
        p = (guests.get((w, c), 0) - o.class_discount * group_tables.get((w, c), 0) + (o.class_strength + o.class_discount * in_class[1]) * p) / (o.class_strength + in_class[0])
        held = sum(v for (_, x), v in tables.items() if x == u)
        return (counts.get((w, u), 0) - o.discount * tables.get((w, u), 0) + (o.strength + o.discount * held) * p) / (o.strength + customers[u])

    assert all(1 <= t <= counts[k] for s in states for k, t in s[0].items()) and any(t > 1 for t in states[0][0].values())
    for state in states:
        for u in range(16):
            assert sum(probability(state, w, u) for w in [*known, -1]) == pytest.approx(1)
    some = every[::9]
    want = Counter((d, round(sum(math.log10(sum(probability(s, number[w], context(a)) for s in states) / 2) for a, w in zip([b"\n", *ws], ws, strict=False)), 6)) for d, _, ws in some)
    found = Counter((r.doc_id, round(r.score, 6)) for r in pitman_yor.score(docs, o).collect())
    assert not want - found


def test_pitman_yor_words_and_seats():
    texts = ["", " \t", "A b\x0bA\x0c\r\n", "É\x1cé x\x85y  z", "\x00 q ", " lead", "one"]
    words, offsets = pitman_yor.words_of(pa.array(["cut off", *texts])[1:])
    listed = words.to_pylist()
    assert [[w.encode() for w in listed[a:b]] for a, b in itertools.pairwise(offsets)] == [t.encode().lower().split() for t in texts]
    o = pitman_yor.Options(block_tokens=4)
    batch = pa.record_batch([pa.array([1, None, 3, 4, 5, 6, 7]), pa.array(texts)], names=["doc_id", "text"])
    number, got = pitman_yor.xxhash.xxh3_64_intdigest, []
    for docs, _, counts, own, contexts, doc, hashes in pitman_yor.blocks(iter([batch]), o, 1 << 16):
        assert counts.sum() == len(own) == len(contexts) == len(doc) and len(docs) == len(counts)
        got += list(zip(hashes[own].tolist(), contexts.tolist(), strict=True))
    sequences = [[*t.encode().lower().split(), b"\n"] for t in texts]
    assert got == [(number(w), pitman_yor.context_of(v, o, 1 << 16)) for s in sequences for v, w in itertools.pairwise([b"\n", *s])]
    rng = np.random.default_rng(1)
    c, odds, keys = rng.integers(1, 60, 500), rng.random(500) * 5, rng.integers(0, 2**62, 500).astype(np.uint64)
    expected = []
    for most, weight, key in zip(c.tolist(), odds.tolist(), keys, strict=True):
        t, n = 1, 1
        while n < most:
            m = min(max(1, n // 16), most - n)
            t += int(m * (weight / (weight + n - 0.75 * t)) + pitman_yor.mixed(np.array([key]), n)[0])
            n += m
        expected.append(t)
    assert pitman_yor.seat(c, odds, 0.75, keys).tolist() == expected


def test_pitman_yor_numbers_words_faster_than_a_loop_over_them():
    text = " ".join(f"w{i * i % 30011}" for i in range(400_000))
    batch = pa.record_batch([pa.array([1, 2]), pa.array([text, text])], names=["doc_id", "text"])

    def loop() -> None:
        index = defaultdict(itertools.count().__next__)
        for t in batch.column(1).to_pylist():
            words = t.encode().lower().split()
            np.fromiter(map(index.__getitem__, words), np.int32, len(words))

    def seconds(f) -> float:
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: list(pitman_yor.blocks(iter([batch]), pitman_yor.Options(), 1 << 16))) < 0.8 * seconds(loop)


def test_pitman_yor_is_the_same_in_any_partitions(spark, docs):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    scores = []
    try:
        for parts in (2, 7, 19):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = pitman_yor.score(docs.repartition(parts), pitman_yor.Options(block_tokens=700 * parts)).collect()
            scores.append(sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 8), round(r.score, 8)) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert scores[0] == scores[1] == scores[2]


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(80)]
        bad = i % 3 == 0
        for _ in range(6 * bad):
            words[rng.randrange(80)] = rng.choice(["nastyword", "vilest", "rottenthing"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad), "y"))
    table = spark.createDataFrame([*rows, (500, None, "x"), (501, "", "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1, "y"), (7, None, "y"), (999, 1, "y")], "doc_id long, toxic int, text string")
    held = common.id_crc_mod("doc_id", 5) == 0
    found = {r.doc_id: r.score for r in toxicity.rate(table, toxicity.train(table, marks, ~held)).collect()}
    assert len(found) == 402 and all(0 <= s <= 1 for s in found.values())
    out = [(found[i], bad) for i, bad, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(bad) for s, bad in out]) > 0.9
    assert toxicity.rate(empty, toxicity.train(empty, marks.limit(0), ~held)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    leak = corpus()[7][1]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lettered = [(r[0], r[1]) for r in corpus() if r[1] and re.search(r"[^\W\d_]", r[1])]
    stays = {d for d, n, c in linked(lettered, 5, 80) if d == c} - {7}
    assert {r.doc_id for r in rows} == stays
    sizes = {d: len(ids_of(t)) for d, t in lettered if d in stays and d not in (88, 90)}
    held = Counter()
    for r in rows:
        held[r.doc_id] += r.length
    assert all(held[d] == n for d, n in sizes.items() if not personal(dict(lettered)[d]))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_pipeline_with_null_and_shared_keys(spark, tmp_path):
    import corpus_pipeline

    leak = " ".join(f"leaked{i}" for i in range(30))
    clean = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(6)]
    rows = [(None, leak), (None, clean[0]), (None, clean[1]), (1, leak), (1, clean[2]), (1, clean[3]), (2, clean[4]), (3, clean[5]), (4, "12 34"), (5, None)]
    docs = spark.createDataFrame([(*r, None, 1) for r in rows], "doc_id long, text string, lang string, _text int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stays = Counter(r for r in rows if r[1] != leak)
    left = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and Counter((r.doc_id, r.text) for r in left.collect()) == stays
    lettered = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in lettered.collect()) == Counter(r for r in rows if r[1] and r[1] != "12 34")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {None, 1, 2, 3}
