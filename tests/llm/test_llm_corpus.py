"""Resampling, the audit of sources and the removal of lines against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftmoor.llm import divergence, lines, resampling, words

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = "n long, rank string, part string, shard string, term string, hi string, id string, n_lines string"
LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(20000))


@pytest.fixture(autouse=True, params=["one slice", "many slices"])
def slices(request, monkeypatch):
    """Tasks work through slices of texts; where they are cut must not matter."""
    if request.param == "many slices":
        monkeypatch.setattr(words.slices, "__defaults__", (2000, 1 << 16))


def frame(spark, rows, columns):
    """Rows with further columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d", "e", "f", "g") for r in rows], f"{columns}, {CLASHES}").repartition(3)


# --- op11 -----------------------------------------------------------------------------------------------------------

def features(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    return found, [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute_resample(docs, target, percent=5, least=20):
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, own = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[5] = k + 1
    return sorted(((r[0], *r[2:]) for r in rows), key=str)


def mixed_texts(seed, count):
    rng = random.Random(seed)
    words = ["the", "Of", "and", "Straße", "x" * 40, "été", "1984", *(f"w{i}" for i in range(300))]
    return [" ".join(rng.choice(words[: rng.choice([5, 20, 307])]) + rng.choice(["", ",", " --"]) for _ in range(rng.randrange(0, 80))) for _ in range(count)]


@pytest.mark.parametrize("share", [2.0**-14, 0.01, 1.0])
def test_resampling(spark, monkeypatch, share):
    """Any head gives the same rows."""
    monkeypatch.setattr(resampling.head_vocabulary, "__defaults__", ("text", share))
    texts = mixed_texts(3, 300) + [None, "", "  -- ", "One", "a\x00b", LONG]
    docs = [(7 * i - 90, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, texts[1]), (5, texts[1]), (None, "w1 " * 30)]
    target = [*mixed_texts(4, 20), None, ""]
    found = resampling.resample(frame(spark, docs, "doc_id long, text string"), frame(spark, [(t,) for t in target], "text string"), percent=40)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in found.dtypes} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=str) == brute_resample(docs, target, 40)


def test_resampling_empty_tables(spark):
    none, some = frame(spark, [], "doc_id long, text string"), frame(spark, [(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert sorted(map(tuple, resampling.resample(some, none).collect()), key=str) == brute_resample([(1, "a b c")], [])


def test_states_follow_from_states():
    rng = random.Random(1)
    words = sorted({bytes(rng.randrange(97, 123) for _ in range(rng.randrange(1, 33))) for _ in range(200)})
    head = resampling.Head(words, [(words[0], words[1]), (words[1], words[1]), (b"gone", words[0])])
    one, other, third = (np.array([rng.randrange(len(words)) for _ in range(500)]) for _ in range(3))
    one[:2], other[:2] = [0, 1], [1, 1]
    pairs = head.paired(one, other)
    assert pairs.tolist() == [zlib.crc32(words[a] + b" " + words[b]) for a, b in zip(one, other)]
    assert head.followed(pairs, third).tolist() == [zlib.crc32(b" ".join((words[a], words[b], words[c]))) for a, b, c in zip(one, other, third)]
    assert len(head.pairs) == 2


def test_ranks_of_equal_scores(spark):
    rows = [(i % 50, 20 + i % 2, 1, 5, 7 + i % 3) for i in range(400)] + [(None, 30, 1, 5, 8), (3, None, 1, 5, 99)]
    found = resampling.drawn(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(5), 50)
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in found.collect() if r.rank)
    assert [r[0] for r in ranked] == list(range(1, 201)) and [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)
    assert found.count() == len(rows)


# --- op12 -----------------------------------------------------------------------------------------------------------

def brute_audit(docs, least=3, most=200):
    n, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
        n[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in held[lang].items() if k >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        q = shares(sum((n[lang, s] for s in sources), Counter()))
        p = {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pair = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, rows in (("pair", pair), ("term", term[:most])) for i, (v, item) in enumerate(rows)]
    return sorted(out)


def audited(spark, docs, **options):
    found = divergence.audit(frame(spark, docs, "text string, lang string, source string"), **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("cells, held", [(1 << 20, 1 << 19), (8, 50)])
def test_audit(spark, monkeypatch, cells, held):
    """Blocks of few cells and tasks that hold few counts give the same rows."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    rng = random.Random(6)
    docs = [(t, rng.choice(["en", "en", None, "", "de"]), rng.choice(["a", "a", "b", "ä", None])) for t in mixed_texts(7, 150)]
    docs += [(None, "en", "only"), ("", "xx", "a"), ("42 !", "xx", "b"), (LONG, "en", "b"), (LONG, "en", "b"), ("rare words", "yy", "a"), ("\x00A\x7fZ", "en", "a")] + [("tie Tie tIE", "zz", s) for s in "abcab"]
    assert audited(spark, docs, most_terms=9) == brute_audit(docs, most=9)


def test_audit_of_an_empty_table(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None)]) == []


def test_shares_of_large_counts():
    counts, total = np.array([0, 5, 10**12, 7 * 10**12]), 8 * 10**12 + 9
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]


# --- op13 -----------------------------------------------------------------------------------------------------------

def brute_lines(docs, least_docs=5, least_chars=40):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)

    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                held[key(line)].add(i)
    top = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if i is None or top.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def deduplicated(spark, docs, **options):
    found = lines.without_repeated_lines(frame(spark, docs, "doc_id long, text string"), **options)
    assert [c for c in found.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")] == ["n", "rank", "part", "shard", "term", "hi", "id"]
    return sorted(map(tuple, found.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (8, 4)])
def test_lines(spark, batches, fanout):
    rng = random.Random(9)
    common = [f"{'é' * (i % 3)}Line {i} of the kind that many a document holds, at {i * i}" for i in range(30)]
    edge = ["e" * 39, "é" * 39, "E" * 40, "É" * 40, " " + "f" * 39, "g" * 39 + "　"]
    docs = []
    for i in range(120):
        own = [rng.choice([*common[: rng.choice([3, 30])], *edge, "short", "", f"only here {i} " * 5]) for _ in range(rng.randrange(0, 12))]
        docs.append((3 * i - 50, "\n".join(rng.choice(["", " ", "\t\x0b"]) + rng.choice([x, x.upper() if x.isascii() else x]) + rng.choice(["", "\r", " \x0c"]) for x in own)))
    docs += [(None, common[0]), (None, common[0]), (900, None), (901, ""), (902, "\n\n"), (903, common[0]), (903, common[0]), (10**12, "\n".join([common[1]] * 3)), (7, LONG + "\n" + common[1])]
    assert deduplicated(spark, docs, batches=batches, fanout=fanout) == brute_lines(docs)


def test_a_line_in_all_documents(spark):
    docs = [(i, f"the footer that stands below every single page\nown {i}") for i in range(300)]
    found = deduplicated(spark, docs, batches=6, fanout=2)
    assert found == brute_lines(docs) and sum(r[3] for r in found) == 299


def test_settled_lines_enter_no_further_run(spark):
    runs = lines.LineRuns(spark, least_docs=3, fanout=9)
    for low in (20, 10, 0):
        runs.add(spark.createDataFrame([(low + i, 1, 1) for i in range(4)] + [(low, 2, low)], "id long, hi long, lo long"))
    assert [spark.table(name).count() for name in runs.levels[0]] == [2, 1, 1]
    assert [tuple(r) for r in runs.repeated().collect()] == [(1, 1, 23)] and not spark.sql("SHOW TABLES LIKE 'line_run*'").count()


def test_lines_of_empty_tables(spark):
    assert deduplicated(spark, []) == []
    assert deduplicated(spark, [(None, None)]) == [(None, "", 1, 0)]


def test_keys_of_lines():
    at, hashes = lines.line_keys(pa.array(["x" * 39, " " + "x" * 40 + "\r", "X" * 40, "ä" * 39, "Ä" * 40, "ä" * 40], pa.large_string()), 40)
    assert at.tolist() == [1, 2, 4, 5] and (hashes[0] == hashes[1]).all() and (hashes[2] != hashes[3]).any()
