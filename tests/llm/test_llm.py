"""The training-data operators against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftmoor.llm.common import few_of_each
from siftmoor.llm import chat, decontamination, language, mixing, nearest, queries, shingles, substrings, suffix_tree, toxicity, url_rules, words
from siftmoor.llm.common import components, fold

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, n long, bucket string, key string, node string"
LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(20000))


def docs_of(spark, texts, ids=None):
    """Documents with columns whose names clash with those that operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "a", 1, "b", "k", "n") for i, t in zip(ids, texts)], DOCS).repartition(3)


def by_id(frame, *columns):
    return {r[0]: tuple(r[1:]) if len(columns) > 1 else r[1] for r in frame.select("doc_id", *columns).collect()}


def prose(seed, count, vocabulary=400):
    rng = random.Random(seed)
    return [f"t{rng.randrange(vocabulary)}" for _ in range(count)]


def split(text):
    return (text or "").encode().split()


ODD = [None, "", "   \t\n", "one", "Ä ö", "no-break\u00a0space stays", "a\x0bb\x0cc", LONG, LONG, "one two three four"]


# --- words and components -------------------------------------------------------------------------------------------

def test_words_are_those_of_bytes_split():
    texts = [*ODD, "x" * 200_000, " lead", "trail "]
    found = words.text_words(pa.array(texts), words.spaces(), False)
    pieces = [bytes(found.data[a:b]) for a, b in zip(found.starts, found.ends)]
    assert pieces == [p for t in texts for p in split(t)]
    assert found.counts.tolist() == [len(split(t)) for t in texts]
    hashes = found.hashes()
    assert len(set(hashes.tolist())) == len(set(pieces)) and len({(h, p) for h, p in zip(hashes.tolist(), pieces)}) == len(set(pieces))


def test_runs_of_two_words_do_not_share_hashes():
    found = words.text_words(pa.array(["of " * 6 + "to " * 6]), words.spaces(), False)
    assert len(set(words.runs(found.hashes(), 5).tolist())) == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (205, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op1 ------------------------------------------------------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    found = queries.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, total = found.where("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * total


def test_language_learns_only_from_its_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = fold("doc_id", 4) == 2
    changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    keep = {"doc_id": F.col("doc_id")}
    one, other = (by_id(language.identify(d, language.fit(d.where(~held)), keep), "lang_pred", "score") for d in (docs, changed))
    assert one == other


def test_language_odd_rows(spark):
    train = spark.createDataFrame([(i, "the house and the tree", "en") for i in range(9)] + [(i + 20, "das haus und der baum", "de") for i in range(9)] + [(50, None, "fr"), (51, "x", None)],
                                  "doc_id long, text string, lang string")
    model = language.fit(train)
    found = by_id(language.identify(docs_of(spark, [None, "", "123 !?", "das haus", "the tree " * 50_000, "ж"]), model, {"doc_id": F.col("doc_id")}), "lang_pred", "score")
    assert [found[i] for i in range(3)] == [("und", 0.0)] * 3
    assert found[3][0] == "de" and found[4][0] == "en" and found[5][0] in ("de", "en")
    assert all(0 <= s <= 1 for _, s in found.values())
    empty = language.fit(train.limit(0))
    assert empty is None and by_id(language.identify(train, empty, {"doc_id": F.col("doc_id")}), "lang_pred")[0] == "und"
    assert language.identify(train.limit(0), model, {"doc_id": F.col("doc_id")}).count() == 0


# --- op2 ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 700, "b": 1, "c": 13, "d": 300}])
def test_pfair_deviates_less_than_one_block(weights):
    slots = mixing.one_period(mixing.shares(weights, 200))
    period = sum(map(len, slots.values()))
    assert sorted(x for s in slots.values() for x in s) == list(range(period))
    for own in slots.values():
        ran = np.isin(np.arange(period), own).cumsum()
        assert (np.abs(ran - np.arange(1, period + 1) * len(own) / period) < 1).all()


def test_mixing_keeps_the_given_weights_over_many_periods(spark):
    rows = spark.range(70000).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id < 50000 THEN 'a' WHEN id < 62000 THEN 'b' WHEN id < 69000 THEN 'c' ELSE 'd' END").alias("source"))
    weights = {"a": 7**0.5, "b": 0.9**0.5, "c": 0.35**0.5, "d": 0.0007}
    found = mixing.mixed(rows, weights, block=2, period=1000).orderBy("mix_position").select("mix_source", "mix_block", "mix_slot", "mix_position").collect()
    assert len({r.mix_position for r in found}) == len(found) == 70000
    blocks = [r.mix_source for r in found if r.mix_position % 2 == 0]
    assert [r.mix_slot for r in found if r.mix_position % 2 == 0] == list(range(35000))
    as_long_as_all_run = min(len(blocks) - blocks[::-1].index(s) for s in "abcd")
    assert as_long_as_all_run > 15000  # many thousands of slots
    blocks = np.array(blocks[:as_long_as_all_run])
    for s, w in weights.items():
        due = np.arange(1, len(blocks) + 1) * w / sum(weights.values())
        assert (np.abs((blocks == s).cumsum() - due) < 1).all(), s
    again = mixing.mixed(rows, weights, block=2, period=77).select("doc_id", "mix_position")
    assert again.exceptAll(mixing.mixed(rows, weights, block=2).select("doc_id", "mix_position")).count() == 0


def test_mixing_keeps_all_rows_and_the_shares(spark):
    rows = [(i, "big" if i < 600 else "small" if i < 900 else None if i < 960 else "few", "x") for i in range(970)] + [(5, "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string").repartition(5)
    found = mixing.mixed(docs, {"big": 3, "small": 2, None: 1}, block=4, period=120).orderBy("mix_position").collect()
    assert Counter((r.doc_id, r.source) for r in found) == Counter((a, b) for a, b, _ in rows)
    assert len({r.mix_position for r in found}) == len(rows)
    blocks = [r.mix_source for r in found if r.mix_position % 4 == 0]
    want = mixing.shares({"big": 3, "small": 2, "": 1, "few": 1}, 120)
    for upto in range(1, 14):  # as long as all sources run
        assert all(abs(blocks[:upto].count(s) - upto * n / 120) < 1 for s, n in want.items())
    assert mixing.mixed(docs.limit(0)).count() == 0


# --- op3 ------------------------------------------------------------------------------------------------------------

def brute_components(texts, ids):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in zip(ids, texts):
        w = [x.translate(low) for x in split(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    rng, texts = random.Random(3), list(ODD)
    base = prose(1, 300)
    for k in range(60):  # drifting copies, around the limit
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
        if k % 6 == 0:
            base = copy
    passage = prose(2, 60)
    texts += [" ".join(prose(100 + k, 40, 10**6) + passage + prose(200 + k, 30, 10**6)) for k in range(40)]
    texts += [" ".join(prose(300 + k // 2, 12, 50)) + (" tail" if k % 2 else "") for k in range(20)]
    texts += ["ONE two", "one TWO", "one two", "a b c d e", "a b c d e"]
    ids = [7 * i - 50 for i in range(len(texts))]
    found = by_id(shingles.near_duplicates(docs_of(spark, texts, ids)), "n_shingles", "component_id")
    assert found == brute_components(texts, ids)


@pytest.mark.parametrize("leaf, count", [(2, 40), (256, 700)])
def test_tree_of_a_crowded_block(spark, monkeypatch, leaf, count):
    """The pairs of the R-tree alone must give every link, within a leaf, between leaves and between bands of sizes."""
    monkeypatch.setattr(shingles, "LEAF", leaf)
    rng = random.Random(5)
    sets = {i: {*range(100, 140 + 30 * (i % 3))} | {rng.randrange(10**9) for _ in range(rng.randrange(0, 25))} for i in range(1, count)}
    points = []
    for values in sets.values():
        groups = shingles.groups_for(len(values))
        hashes = words.mixed(np.array(sorted(values), np.uint64))
        points.append(np.bincount((hashes & np.uint64(groups - 1)).astype(int), minlength=groups).astype(np.uint16))
    nodes = spark.createDataFrame([(i, len(sets[i]), bytearray(p)) for i, p in zip(sets, shingles.packed(points))], "node long, n long, point binary")
    mixed = spark.createDataFrame([(1, i, i) for i in sets], "block long, node long, component long")
    found = {(r.a, r.b) for r in shingles._tree_pairs(mixed, nodes).collect()}
    near = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    bands = {math.floor(math.log(len(s)) / math.log(5 / 4)) for s in sets.values()}
    assert near and near <= found and len(bands) > 2


def test_near_duplicates_odd_tables(spark):
    assert shingles.near_duplicates(docs_of(spark, []).limit(0)).count() == 0
    found = shingles.near_duplicates(docs_of(spark, ["a b c d e f", "a b c d e f", "q", "a b c d e f"], [4, 4, None, 9])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == [(4, 2, 4), (4, 2, 4), (9, 2, 4), (None, 1, None)]


# --- op4 ------------------------------------------------------------------------------------------------------------

def brute_removal(texts, ids, window=13):
    first = {}
    for i, t in sorted((i, t) for i, t in zip(ids, texts) if i is not None):
        w = split(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in zip(ids, texts):
        w = split(t)
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_substrings_by_brute_force(spark):
    passage, hot = prose(8, 55), prose(9, 20)
    texts = list(ODD)
    for k in range(60):
        body = prose(k, 80, 10**6)
        texts.append("  ".join(body[:30] + (passage[k % 9 : 55 - k % 5] if k % 3 else []) + body[30:50] + hot + body[50:]))
    texts += [" ".join(["same"] * 40), " ".join(["same"] * 30), " ".join(hot * 3), " ".join(prose(9, 12)), " ".join(prose(9, 13))]
    ids = [None, *[100 - i for i in range(1, len(texts))]]
    found = by_id(substrings.without_repeats(docs_of(spark, texts, ids)), "n_words", "n_removed", "text")
    assert found == brute_removal(texts, ids)


def test_substrings_compares_words_when_hashes_meet(monkeypatch):
    hashes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.uint64)
    monkeypatch.setattr(words, "runs", lambda values, length: np.zeros(len(values) - length + 1, np.uint64))
    order, new = substrings._leaders(hashes, np.array([0, 3, 6]), 3)
    assert new.sum() == 2 and sorted(order.tolist()) == [0, 1, 2]


def test_substrings_odd_tables(spark):
    assert substrings.without_repeats(docs_of(spark, []).limit(0)).count() == 0
    found = substrings.without_repeats(docs_of(spark, [LONG, LONG, LONG], [3, 3, 5])).select("doc_id", "n_removed", "id", "bucket").collect()
    assert sorted(map(tuple, found)) == [(3, 0, "a", "b"), (3, 0, "a", "b"), (5, 40000, "a", "b")]


# --- op5 ------------------------------------------------------------------------------------------------------------

def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 80))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        assert decontamination.longest_common(a, b) == row[-1]


def test_decontamination(spark):
    items = [(i, " ".join(prose(1000 + i, 30, 3000))) for i in range(30)] + [(90, None), (91, ""), (92, " ".join(prose(7777, 150, 3000)))]
    plain = [" ".join(prose(i, 150, 3000)) for i in range(120)]
    texts = list(ODD) + plain
    for i in range(10):
        verbatim = items[i][1].upper().replace(" ", ", ")
        texts.append(f"{plain[i]} {verbatim}. {plain[i + 1]}")
    held = len(texts)
    for i in range(10, 20):  # over half of the words in order, the answer whole
        w = items[i][1].split()
        texts.append(" ".join(prose(5000 + i, 40, 3000) + [x for k, x in enumerate(w) if k % 2 or k >= 24] + prose(6000 + i, 40, 3000)))
    texts += [" ".join(prose(50 + i, 80, 3000) + items[i][1].split()[:6] + prose(70 + i, 80, 3000)) for i in range(10)]
    docs = docs_of(spark, texts)
    found = {(r.doc_id, r.item_id): r.kind for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    start = len(ODD) + len(plain)
    want = {**{(start + i, i): "verbatim" for i in range(10)}, **{(held + i - 10, i): "paraphrase" for i in range(10, 20)}}
    assert found == want, set(found.items()) ^ set(want.items())
    assert decontamination.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontamination.contaminated(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_finds_items_of_common_words(spark):
    plain = [" ".join(prose(i, 150, 3000)) for i in range(120)]
    items = [(0, " ".join(f"hot{i}" for i in range(20))), (1, " ".join(f"warm{i}" for i in range(40))), (2, " ".join(f"cool{i}" for i in range(20)))]
    put = lambda t, i, at=70: " ".join(t.split()[:at] + items[i][1].split() + t.split()[at:])
    # Item 0 is in a third of the documents, item 1 in 7 % and item 2 in 4 %; the common words alone, far apart, are not the item.
    texts = [put(t, 0, 1 + i) if i % 3 == 0 else put(t, 1, 3 * i % 140) if i < 12 else put(t, 2) if i in (13, 16, 19, 22, 25) else t for i, t in enumerate(plain)]
    texts[100] = " ".join(f"hot{i % 20} " + " ".join(prose(i, 6, 3000)) for i in range(40))
    found = decontamination.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, j): "verbatim" for i, t in enumerate(texts) for j, x in items if x in t}
    assert {(r.doc_id, r.item_id): r.kind for r in found} == want and len(want) == 40 + 8 + 5


def test_decontamination_finds_paraphrases_of_long_items(spark):
    """As comparing every passage with every piece by the cosine of the whole vectors does, also if there are more pieces than a block takes."""
    items = [(i, " ".join(prose(9000 + i, 150, 3000))) for i in range(250)]
    texts = [" ".join(prose(i, 150, 3000)) for i in range(40)]
    for i in range(0, 250, 5):  # some 65 % of the words in order, the answer whole
        own = items[i][1].split()
        texts.append(" ".join(prose(5000 + i, 40, 3000) + [x for k, x in enumerate(own) if k % 3 or k >= 140] + prose(6000 + i, 40, 3000)))
    docs, asked = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    find = lambda least: {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, asked, least_cosine=least).collect()}
    found = find(decontamination.LEAST_COSINE)
    whole = find(-1e-3)
    assert len(whole) >= 40 and len(found & whole) >= 0.9 * len(whole) and found <= whole


def test_latent_cosines_are_those_of_whole_vectors():
    rng = np.random.default_rng(1)
    pieces, idf = [rng.integers(0, 300, 48) for _ in range(80)] + [np.arange(3), np.arange(3)], rng.uniform(0.1, 5, 300).astype(np.float32)
    basis, latent = decontamination._latent(pieces, idf)
    passages = [rng.integers(-1, 300, 64) for _ in range(50)]
    whole = lambda p: np.sqrt(np.bincount(p[p >= 0], minlength=300)) * idf
    want = [[whole(p) @ whole(q) / np.linalg.norm(whole(q)) for q in pieces] for p in passages]
    assert np.allclose([whole(p) @ basis @ latent.T for p in passages], want, atol=1e-3)


def test_corpus_space_is_that_of_all_passages(spark, monkeypatch):
    """Against the singular vectors of the whole matrix: no document and no passage is left out, and each word counts once."""
    monkeypatch.setattr(decontamination, "RANK", 6)
    monkeypatch.setattr(decontamination, "ROWS", 7)
    monkeypatch.setattr(decontamination, "OFTEN", 20)
    rng = np.random.default_rng(2)
    topics = [[f"t{t}x{i}" for i in range(12)] for t in range(6)]  # each has its own share of the texts; the last is in one text only
    texts = [" ".join([*rng.choice(topics[t], n), "filler"]) for t, n in [*((i % 5, 20 + 9 * i) for i in range(40)), (5, 1500)]] + [None, "", "filler"]
    vocabulary = decontamination.Vocabulary(decontamination.w.text_words(pa.array([" ".join(sum(topics, []))]), decontamination.w.not_alphanumeric(), True).hashes())
    idf = rng.uniform(0.5, 3, 72).astype(np.float32)
    rows = docs_of(spark, texts).select(F.col("doc_id").alias("id"), "text")
    pieces = [np.arange(10), np.arange(30, 40)]
    space = decontamination._corpus_space(decontamination._coded(rows, vocabulary), np.append(np.arange(72), -1), idf, pieces)
    matrix = [np.bincount(p, minlength=72) for p in pieces]
    for text in texts:
        words = (text or "").split()
        for at in range(0, len(words), decontamination.PASSAGE):
            hashes = decontamination.w.text_words(pa.array([" ".join(words[at : at + decontamination.PASSAGE])]), decontamination.w.not_alphanumeric(), True).hashes()
            places = vocabulary.places(hashes)
            matrix.append(np.bincount(places[places >= 0], minlength=72))
    leading = np.linalg.svd(np.sqrt(np.array(matrix)) * idf)[2][:6]
    assert space.shape == (72, 22) and np.allclose(space.T @ space, np.eye(22), atol=1e-4)
    assert (np.linalg.norm(leading @ space, axis=1) > 0.999).all()


def related_words():
    """Texts and items; the last text has half of the short item 0 among words that go with it in the corpus."""
    rng = random.Random(8)
    topic = [f"topic{i}" for i in range(60)]
    items = [(0, " ".join(topic[:10]), topic[8]), (1, " ".join(topic[10:]), "none"), (2, " ".join(prose(77, 150, 3000)), "none")]
    texts = [" ".join(rng.sample(topic, 24) + prose(i, 40, 3000)) if i % 25 == 0 else " ".join(prose(i, 150, 3000)) for i in range(300)]
    others = topic[10:]
    rng.shuffle(others)
    return [*texts, " ".join(prose(500, 64, 3000) + others[:25] + [topic[i] for i in (0, 2, 4, 6, 8)] + others[25:50] + prose(501, 64, 3000))], items


def test_decontamination_finds_paraphrases_by_related_words(spark, monkeypatch):
    """Too few of the item's own words for the cosine of the whole vectors."""
    monkeypatch.setattr(decontamination, "RANK", 4, raising=False)
    monkeypatch.setattr(decontamination, "EXTRA", 2, raising=False)
    texts, items = related_words()
    asked = spark.createDataFrame(items, "item_id long, text string, answer string")
    found = decontamination.contaminated(docs_of(spark, texts), asked).where("item_id = 0").collect()
    held = {r.doc_id: r for r in found}
    assert held[300].kind == "paraphrase" and held[300].lcs == 0.5 and held[300].cosine < decontamination.LEAST_COSINE


def test_dense_stretches_by_brute_force(monkeypatch):
    monkeypatch.setattr(decontamination, "WORDS_AT_ONCE", 50)
    rng = random.Random(3)
    pieces = [np.array([rng.randrange(12) for _ in range(n)]) for n in (1, 2, 3, 5, 8, 20, 48)]
    texts = [[rng.randrange(-1, 12) for _ in range(rng.randrange(0, 90))] for _ in range(30)] + [[rng.randrange(12), *p.tolist()[: len(p) // 2], -1, *p.tolist()[len(p) // 2 :], 3] for p in pieces]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = decontamination.Dense(pieces, np.array([rng.randrange(50) for _ in range(12)])).passages(np.array([x for t in texts for x in t]), first)
    want = set()
    for t, words in enumerate(texts):
        for j, piece in enumerate(pieces):
            need, span = math.ceil(len(piece) * 0.8 - 1e-9), int(len(piece) / 0.8 + 1e-9)
            if any(decontamination.longest_common(piece.tolist(), words[i : i + span]) >= need for i in range(len(words))):
                want.add((t, j))
    assert {(t, j) for (t, _), js in found.items() for j in js} == want and want


def test_decontamination_finds_every_item_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in (t or "").lower()).split()) + " "
    want = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()} == want


# --- op6 ------------------------------------------------------------------------------------------------------------

def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "<s>", "</s>", "[/INST]", "<<SYS>>", "<</SYS>>", "a", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    controls = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
    assert all(r.t == r.u and not any(c in r.e for c in controls) for r in rows)


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be\n</s> brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "[INST] yes"), (1, 3, "user", None), (1, 4, "assistant", "ok \\<s>"), (1, 5, "user", "bye"),
            (2, 0, "user", "alone"), (3, None, None, ""), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a"), (None, 0, "assistant", "lost"),
            (5, 0, "we<s>\nird", "x"), (5, 1, "assistant", "")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, turns string").repartition(4)
    found = chat.examples(frame)
    for r in found.collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert r.formatted.count("<s>") == r.target == r.formatted.count("</s>") and r.target <= len(own)
    assert sorted(r.target for r in found.where("conv_id = 1").collect()) == [3, 5, 6]
    read = {r.conv_id: r for r in chat.digests(found).collect()}
    assert set(read) == {1, 2, 3, 4, 5}
    for conv, r in read.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.examples(frame.limit(0))).count() == 0


# --- op7 ------------------------------------------------------------------------------------------------------------

def test_nearest_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = {i: rng.standard_normal(12).tolist() for i in range(300)}
    for i in range(40, 60):
        rows[i] = rows[40]  # ties
    rows |= {300: None, 301: [], 302: [0.0] * 12, 303: [float("nan")] * 12, 304: [float("inf")] * 12, 305: [1.0] * 5, 306: [1e200] * 12, 307: [1e-200] * 12, 308: [None] * 12}
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows.items()] + [(None, [1.0] * 12, "x")], "vec_id long, embedding array<double>, id string").repartition(5)
    found = nearest.nearest(frame, F.col("vec_id") % 10 == 0, k=5).collect()
    usable = {i: np.array(v) for i, v in rows.items() if i < 300 or i in (306, 307)}
    for q in [i for i in usable if i % 10 == 0]:
        scores = nearest.cosines(np.array([usable[q]] * (len(usable) - 1)), np.array([v for i, v in usable.items() if i != q]))
        want = sorted(zip(-scores, [i for i in usable if i != q]))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert own == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert nearest.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank) for r in nearest.nearest(alone, F.col("vec_id") == 0).collect()] == [(1, 1)]


def test_quantised_bound_holds():
    rng = np.random.default_rng(6)
    one, other = (nearest._Block(24, np.arange(a, a + 50).tobytes(), (rng.standard_normal((50, 24)) ** 3).tobytes()) for a in (0, 50))
    left, right = nearest._survivors(one, other, 3, np.full(50, -np.inf))
    exact = nearest.cosines(np.repeat(one.vectors, 50, axis=0), np.tile(other.vectors, (50, 1))).reshape(50, 50)
    kept = set(zip(left.tolist(), right.tolist()))
    assert all((i, j) in kept for i in range(50) for j in np.argsort(-exact[i])[:3]) and len(kept) < 1000


def test_nearest_grid(spark, monkeypatch):
    """Whatever grid the blocks meet in, the result is the same; the grid copies far fewer vectors than there are cells."""
    assert nearest.grid(8, 20, 1000) == (1, 8) and nearest.grid(1, 5, 5) == (1, 1) and nearest.grid(4, 0, 0)[0] >= 1
    lines, columns = nearest.grid(10_000, 20, 1000)
    assert lines * columns <= 10_000 and columns * 20 + lines * 1000 < 10_000 * 20 / 6
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nearest, "BLOCK", 16)
    found = []
    for shape in ((1, 1), (1, 4), (3, 2), (4, 1)):
        monkeypatch.setattr(nearest, "grid", lambda *_: shape)
        found.append(sorted(map(tuple, nearest.nearest(rows, F.col("vec_id") % 20 == 0).collect())))
    assert found[0] and all(f == found[0] for f in found)


def test_nearest_sends_no_vectors_through_the_driver(spark):
    """A block stands in every column, which Spark's sizes do not show: blocks are shuffled, also if the queries are few and small."""
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 11), 1.0]) for i in range(400)], "vec_id long, embedding array<double>").repartition(3)
    found = nearest.nearest(rows, F.col("vec_id") % 20 == 0)
    assert found.count() == 20 * 5
    whole = found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    narrow = nearest.nearest(rows.withColumn("embedding", F.col("embedding").cast("array<float>")), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, narrow)) == sorted(map(tuple, whole))


def test_cells_copy_few_vectors():
    """At any number of shuffle partitions: what is moved is bound by the vectors, but no core stays idle."""
    for most, cores, queries, candidates in ((600, 6, 20_000, 1_000_000), (10_000, 6, 300_000, 15_000_000), (4, 2, 5, 100)):
        cells = nearest.cells_for(most, cores, queries, candidates)
        lines, columns = nearest.grid(cells, queries, candidates)
        assert min(most, cores) <= cells <= most and columns * queries + lines * candidates <= 3 * candidates
    assert nearest.cells_for(1000, 50, 100, 100) == 100 and nearest.cells_for(8, 2, 0, 0) == 4


# --- op8 ------------------------------------------------------------------------------------------------------------

def test_url_rules_by_brute_force(spark):
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "xexample.com", "net", "x.net", "com.", ".com", "", "example.org", "EXAMPLE.com"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/es/1", "/fr/"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#://net/es/")] + [None, "", "no scheme", "a://b://c/d"]
    rules = [*queries.URL_RULES, ("example.com", "/", "allow"), ("b.example.com", "/", "block"), ("net", "/es/", "allow"), (None, "/", "block"), ("org", None, "block")]
    frame = spark.createDataFrame([(i if i else None, u, "h") for i, u in enumerate(urls)] + [(1, urls[1], "h")], "page_id long, url string, host string").repartition(6)
    found = url_rules.judge_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(found) == len(urls) + 1

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        return host, path, best[3], best[4]

    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id or 0])
    assert url_rules.judge_urls(frame.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(frame, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


# --- op9 ------------------------------------------------------------------------------------------------------------

def test_toxicity_learns_and_leaves_mentions_alone(spark):
    rng = random.Random(9)
    texts, marks = [], []
    for i in range(600):
        body, toxic = prose(i, 30, 200), int(i % 3 == 0)
        if toxic:
            body[rng.randrange(30)] = rng.choice(["vileword", "grimword"])
        if rng.random() < (0.7 if toxic else 0.1):  # a mention that goes with the label by accident
            body[0] = "women"
        texts.append(" ".join(body))
        marks.append(toxic)
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, m, "x") for i, m in enumerate(marks)] + [(None, 1, "x"), (3, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    found = by_id(toxicity.score(docs, model, {"doc_id": F.col("doc_id")}), "score", "predicted")
    assert sum(found[i][1] == m for i, m in enumerate(marks)) >= 590
    neutral = model.scores(pa.array(["women t1 t2 t3", "men t1 t2 t3", "t1 t2 t3", None, ""]))
    assert abs(neutral[0] - neutral[1]) < 0.05 and (neutral < 0.3).all()
    plain = toxicity.score(docs_of(spark, ODD), model, {"doc_id": F.col("doc_id")})
    assert len(by_id(plain, "score")) == len(ODD) and all(0 <= s <= 1 for s in by_id(plain, "score").values())
    assert toxicity.without_toxic(docs, model).count() == sum(p == 0 for _, p in found.values())
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), nothing, {"doc_id": F.col("doc_id")}).count() == 0 and 0 < nothing.scores(pa.array(["x"]))[0] < 1


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A word that stands only in texts beyond the 2,000 of the smallest hashes counts; the sums do not depend on the cut of the rows."""
    plain = [" ".join(prose(i, 12, 200)) for i in range(4800)]
    rows = spark.createDataFrame([(i, int(i % 2)) for i in range(4800)], "id long, toxic int")
    first = {r.id for r in few_of_each(rows, "toxic", 2000).collect()}
    texts = [t if i % 2 == 0 else f"{t} {'vileword' if i in first else 'grimword'}" for i, t in enumerate(plain)]
    docs, labels = docs_of(spark, texts), rows.withColumnRenamed("id", "doc_id")
    model = toxicity.fit(docs, labels)
    assert (model.scores(pa.array(["t1 t2 vileword", "t1 t2 grimword"])) > 0.9).all() and model.scores(pa.array(["t1 t2 t3"]))[0] < 0.3
    again = toxicity.fit(docs.repartition(7), labels)
    assert (model.features == again.features).all() and (model.weights == again.weights).all()


def test_few_of_each(spark):
    """The ids of the smallest hashes of each label, with one label on nearly all rows, and fewer rows than wanted."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") < 40, F.lit("few")).otherwise(F.when(F.col("id") % 300 == 0, F.lit("some")).otherwise(F.lit("hot"))).alias("label"))
    hashes = {}
    for r in rows.withColumn("h", F.xxhash64("id")).collect():
        hashes.setdefault(r.label, []).append((r.h, r.id))
    found = {}
    for r in few_of_each(rows, "label", 100).collect():
        found.setdefault(r.label, set()).add(r.id)
    assert found == {label: {i for _, i in sorted(pairs)[:100]} for label, pairs in hashes.items()}
    assert few_of_each(rows.limit(0), "label", 5).count() == 0


def test_samples_of_repeated_ids(spark):
    """A row that stands there many times changes no model, however often it does."""
    texts = [f"you are a nasty fool {i}" if i % 3 == 0 else f"a quiet day at the sea {i}" for i in range(300)]
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = spark.createDataFrame(rows + rows[:1] * 5000 + rows[3:4] * 5000, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] * 2, "doc_id long, toxic int")
    keep = {"doc_id": F.col("doc_id")}
    first, second = (by_id(toxicity.score(once, toxicity.fit(docs, labels, sample_rows=50), keep), "score") for docs in (once, often))
    assert first == second
    first, second = (by_id(language.identify(once, language.fit(docs, sample_rows=60), keep), "lang_pred", "score") for docs in (once, often))
    assert first == second


# --- op10 -----------------------------------------------------------------------------------------------------------

def test_suffix_tree(spark):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    texts = [" ".join(["The cat sat"] * (1 + i % 5) + prose(i, 20, 60)) for i in range(200)] + ODD
    ids = [None if t == "one" else i for i, t in enumerate(texts)]
    docs = docs_of(spark, texts, ids)
    tree, counted = suffix_tree.fit(docs.where(fold("doc_id", 7) != 2))
    keep = {"doc_id": F.col("doc_id"), "held_out": fold("doc_id", 7) == 2}
    tokens = {i: [x.translate(low) for x in split(t)] + [None] for i, t in zip(ids, texts)}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids}
    counts = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    total, distinct = sum(counts.values()), len(counts)
    found = suffix_tree.score(docs, (tree, counted), keep).collect()
    assert len(found) == len(texts)
    for r in found:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[x] > 0 for x in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in own))
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)
    assert any(level.kept.any() for level in tree.levels) and len(tree.levels) == 2
    # The distribution of every state sums to one over all symbols, those outside the model and the unknown word.
    every = np.arange(len(tree.counts))
    rest = 1 - (10 ** tree.base(every)).sum()
    for depth, level in enumerate(tree.levels):
        for state in range(0, len(level.codes), 7):
            chain = tree.chain(depth, np.full(len(every) + 1, state))
            gains = tree.gains(chain, np.append(every, -1))
            assert (10 ** (tree.base(every) + gains[:-1])).sum() + rest * 10 ** gains[-1] == pytest.approx(1)


def test_suffix_tree_uses_all_contexts_and_next_words(spark, monkeypatch):
    # Rare contexts (two occurrences among 60,000 tokens) count, and so do all their next words, cached or not.
    texts = [" ".join(prose(i, 200, 3000)) for i in range(300)] + ["alpha beta gamma", "alpha beta gamma", "alpha beta delta", ""]
    asked = ["alpha beta gamma", "alpha beta delta", "alpha beta t1", "beta gamma", "new alpha beta", texts[7], texts[9] + " alpha beta gamma"]
    grams, follow = Counter(), {}
    for t in texts:
        own = [*t.split(), None]
        for size in (1, 2, 3):
            for i in range(len(own) - size + 1):
                run = tuple(own[i : i + size])
                grams[run] += 1
                if size > 1:
                    follow.setdefault(run[:-1], Counter())[run[-1]] += 1
    total, distinct = sum(n for g, n in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    smooth = suffix_tree.SMOOTHING

    def kept(context):
        if context not in follow or sum(follow[context].values()) < 2:
            return False
        n, left = sum(follow[context].values()), 1.0
        divergence = 0.0
        for x, k in follow[context].items():
            before = chance(context[1:], x)
            told = (k + smooth * before) / (n + smooth)
            divergence, left = divergence + told * math.log2(told / before), left - told
        return divergence + left * math.log2(smooth / (n + smooth)) >= suffix_tree.LEAST_DIVERGENCE

    def chance(context, x):
        if not context:
            return (grams[(x,)] + 1) / (total + distinct + 1)
        before = chance(context[1:], x)
        return (follow[context][x] + smooth * before) / (sum(follow[context].values()) + smooth) if kept(context) else before

    want = [sum(math.log10(chance(tuple(own[max(0, i - 2) : i]), x)) for i, x in enumerate(own)) for own in ([*t.split(), None] for t in asked)]
    for share in (2.0**-18, 0.001, 1.0):
        monkeypatch.setattr(suffix_tree, "CACHE_SHARE", share, raising=False)
        found = by_id(suffix_tree.score(docs_of(spark, asked), suffix_tree.fit(docs_of(spark, texts)), {"doc_id": F.col("doc_id")}), "score")
        assert [found[i] for i in range(len(asked))] == pytest.approx(want)
    assert kept(("alpha", "beta"))


def test_suffix_tree_leaves_few_files(spark, tmp_path, monkeypatch):
    """Fitted and scored, next to no shuffle files are left; few symbols and marks change no score."""
    texts = [" ".join(prose(i, 20000, 4000)) for i in range(100)]
    docs, keep = docs_of(spark, texts), {"doc_id": F.col("doc_id")}
    files = lambda: {f: f.stat().st_size for f in Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*")}
    before = files()
    scored = suffix_tree.score(docs, suffix_tree.fit(docs), keep)
    assert sum(size for f, size in files().items() if f not in before) < 1_000_000
    first = by_id(scored, "score")
    monkeypatch.setattr(suffix_tree, "SYMBOLS", 50)
    monkeypatch.setattr(suffix_tree, "MARK_BITS", 8)
    second = by_id(suffix_tree.score(docs, suffix_tree.fit(docs), keep), "score")
    assert [first[i] for i in range(len(texts))] == pytest.approx([second[i] for i in range(len(texts))])


def test_suffix_tree_tasks_have_one_python_step(spark, monkeypatch, capsys):
    """A task has a worker for each Python step, and workers keep the memory that they took: so no step follows another."""
    real, most = suffix_tree.stage, []

    def staged(table, *args, **kwargs):
        table.explain()
        steps = 0
        for line in capsys.readouterr().out.splitlines():
            steps = 0 if re.search(r"Exchange|Union|Scan", line) else steps + bool(re.search(r"(Map|Groups)InArrow", line))
            most.append(steps)
        return real(table, *args, **kwargs)

    monkeypatch.setattr(suffix_tree, "stage", staged)
    docs = docs_of(spark, [" ".join(prose(i, 50, 100)) for i in range(20)])
    suffix_tree.score(docs, suffix_tree.fit(docs), {"doc_id": F.col("doc_id")})
    assert max(most) == 1


def test_suffix_tree_odd_tables(spark):
    empty = docs_of(spark, []).limit(0)
    model = suffix_tree.fit(empty)
    assert suffix_tree.score(empty, model, {"doc_id": F.col("doc_id")}).count() == 0
    found = suffix_tree.score(docs_of(spark, [None, "a b"]), model, {"doc_id": F.col("doc_id")}).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in found) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


# --- the pipeline ---------------------------------------------------------------------------------------------------

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, before = docs, docs
    for _, step in corpus_pipeline.STAGES[:4]:
        before, kept = kept, step(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count()
    near = shingles.near_duplicates(corpus_pipeline.STAGES[0][1](spark, docs, SF))
    assert near.where("component_id < doc_id").count() and near.where("component_id < doc_id").join(kept, "doc_id").count() == 0
    assert queries.decontamination.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    found = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in found.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert found.select("mix_position").distinct().count() == kept.count()
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0


def test_pipeline_takes_out_paraphrases_by_related_words(spark, monkeypatch, tmp_path):
    """Its stage searches in a space of all documents that came so far, and only what it finds goes."""
    monkeypatch.setattr(decontamination, "RANK", 4, raising=False)
    monkeypatch.setattr(decontamination, "EXTRA", 2, raising=False)
    texts, items = related_words()
    spark.createDataFrame(items, "item_id long, text string, answer string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(spark, texts)
    kept = {r.doc_id for r in corpus_pipeline.benchmark_out(spark, docs, str(tmp_path)).collect()}
    found = {r.doc_id for r in decontamination.contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert 300 not in kept and kept == set(range(301)) - found and len(kept) > 280
