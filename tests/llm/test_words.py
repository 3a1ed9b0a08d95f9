"""Spelling variants, decontamination and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import collocations, contamination, spelling

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def wordy(spark, odd_docs):
    """odd_docs and rows with runs of equal letters, long runs and mixed case."""
    rng = random.Random(11)
    syllable = ["ba", "be", "La", "lé", "É", "ss", "ß", "×", "o", "aa"]
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randrange(2, 5)))
    rows = [(1000 + k, " ".join(word() for _ in range(rng.randrange(0, 90))), rng.choice(["en", "xx", None]), "s", 0, 2, "z") for k in range(120)]
    rows += [(2000 + k, "a" * 3000 + " " + "a" * 3001 + " aaaaa aaaaaa aaaaa baaaaa", "en", "s", 0, 2, "z") for k in range(3)]
    return odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema)).repartition(4)


# ---- spelling variants

def near_by_deletions(words):
    """Neighbours by the strings that remain when a letter goes or is masked."""
    found, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            found[w[:i], w[i + 1 :]].add(w)
    for same in found.values():
        for w in same:
            near[w] |= same - {w}
    for w in words:
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    return near


def spelling_by_hand(docs, drop):
    counts = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = run.translate(AZ)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 5
    words = {w: n for w, n in counts.items() if n >= 3}
    near = near_by_deletions(words)
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


@pytest.mark.parametrize("drop", [97, 5])
def test_spelling(wordy, drop):
    got = spelling.spelling_variants(wordy, drop=drop).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = spelling_by_hand(wordy, drop)
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want


def test_spelling_of_nothing(no_docs):
    got = spelling.spelling_variants(no_docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_rounds_of_small_tries(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 9) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = near_by_deletions(words)
    want = {(w, n, len(near[w])) + next(((words[b], b) for b in sorted(near[w], key=lambda x: (-words[x], x))), (None, None)) for w, n in words.items()}
    assert {tuple(r) for r in spelling.near_words(df, shard=23, most=900).collect()} == want


def test_tries_pack_and_find():
    words = sorted({"a", "ab", "abc", "b", "bb", "é", "zzz"}, key=lambda w: w.encode("latin-1"))
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    trie = spelling.Trie.unpack(spelling.Trie(data, off, np.arange(len(words))).pack())
    assert [trie.word(k) for k in range(len(words))] == words and trie.counts.tolist() == list(range(len(words)))
    asked, found = spelling.neighbours(trie, data, off)
    assert sorted((words[a], words[b]) for a, b in zip(asked, found, strict=True)) == sorted((a, b) for a, bs in near_by_deletions(set(words)).items() for b in bs)


def test_chains_end_at_the_last(spark):
    links = [(f"w{k:03}", f"w{k + 1:03}") for k in range(40)] + [("x", "w010"), ("y", "z")]
    got = {tuple(r) for r in spelling.last_of_chains(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {(a, "z" if a == "y" else "w040") for a, _ in links}


# ---- decontamination

@pytest.fixture(scope="module")
def tests_table(spark, odd_docs):
    """Items taken from documents, short, empty, repeated, long and foreign ones."""
    rng = random.Random(2)
    texts = [r.text for r in odd_docs.where("text is not null and length(text) > 400").orderBy("doc_id").limit(40).collect()]

    def part(text, n):
        k = rng.randrange(max(1, len(text.split()) - n))
        return " ".join(text.split()[k : k + n])

    rows = [(k, part(rng.choice(texts), rng.randrange(5, 40))) for k in range(25)]
    rows += [(30, None), (31, ""), (32, "..."), (33, "w1"), (34, "w1 W2"), (35, "never seen words at all in any of the texts here"), (36, "a " * 50), (36, "b c"), (37, texts[0]), (38, texts[0].upper())]
    rows += [(40, "w5 " * 9), (41, "w5 " * 30), (None, part(texts[1], 12))]
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks_by_hand(docs, items, size=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: pattern.findall((t or "").translate(AZ))
    windows, listed = defaultdict(set), []
    for r in items.collect():
        w, name = words(r.text), "" if r.item_id is None else str(r.item_id)
        listed.append((name, w))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(name)
    out = []
    for r in docs.collect():
        w, hit, ids = words(r.text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    ids |= found
        longest = 0
        for _, x in listed if hit else ():
            run = [0] * (len(x) + 1)
            for a in w:
                run = [0] + [run[j] + 1 if a == x[j] else 0 for j in range(len(x))]
                longest = max(longest, *(n for n in run if n >= min(size, len(x))), 0) if x else longest
        out.append((r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), longest))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,shard", [(1 << 19, 4 << 20), (150, 4 << 20), (400, 3000)])
def test_leaks(odd_docs, tests_table, monkeypatch, block, shard):
    monkeypatch.setattr(contamination, "BLOCK", block)
    monkeypatch.setattr(contamination, "SHARD", shard)
    docs = odd_docs.where("doc_id is null or doc_id <> 96") if block > 1000 else odd_docs
    got = sorted((tuple(r) for r in contamination.contamination_digests(docs, tests_table).collect()), key=str)
    want = leaks_by_hand(docs, tests_table)
    assert got == want and sum(r[5] for r in want) > 20


def test_segments_hold_all_windows(spark):
    rng = random.Random(8)
    text = [rng.choice("abcdefgh") for _ in range(100)]
    parts = contamination.segments(spark.createDataFrame([(1, " ".join(text))], "item_id long, text string"), window=10, segment=16).collect()
    words = np.frombuffer(next(p.words for p in contamination.segments(spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")).collect()), np.uint64).tolist()
    seen = {p.begin + k: np.frombuffer(p.words, np.uint64).tolist()[k : k + 10] for p in parts for k in range(len(p.words) // 8 - 9)}
    assert max(len(p.words) for p in parts) <= 16 * 8 and seen == {k: words[k : k + 10] for k in range(91)}


def test_matches_are_verbatim(odd_docs, tests_table):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    texts, items = defaultdict(list), defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(pattern.findall((r.text or "").translate(AZ)))
    for r in tests_table.collect():
        items["" if r.item_id is None else str(r.item_id)].append(pattern.findall((r.text or "").translate(AZ)))
    rows = contamination.leaks(odd_docs, tests_table).where("size(matches) > 0").collect()
    assert rows
    for r in rows:
        assert r.longest == max(m.n_words for m in r.matches)
        for m in r.matches:
            assert any(m.n_words > 0 and w[m.word : m.word + m.n_words] == x[m.item_word : m.item_word + m.n_words] for w in texts[r.doc_id] for x in items[m.item_id])


def test_decontaminate_keeps_clean_rows_and_columns(spark, odd_docs, tests_table, no_docs):
    kept = contamination.decontaminate(odd_docs.withColumnRenamed("h", "hits"), tests_table)
    clean = Counter(r[0] for r in leaks_by_hand(odd_docs, tests_table) if not r[5])
    assert kept.columns == [c if c != "h" else "hits" for c in odd_docs.columns] and Counter(r.doc_id for r in kept.collect()) == clean
    none = tests_table.where("false")
    assert contamination.decontaminate(odd_docs, none).count() == odd_docs.count()
    assert contamination.contamination_digests(no_docs, tests_table).count() == 0


# ---- collocations

def collocations_by_hand(docs, least, top):
    counts, total = defaultdict(Counter), Counter()
    for r in docs.collect():
        lang = "und" if r.lang is None else r.lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r.text or "").translate(AZ)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        over = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    over[p[i : i + m]] = max(over[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if 100 * over[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least,top", [(3, 2000), (2, 15)])
def test_collocations(spark, wordy, least, top):
    extra = [(3000 + k, "New  York\tcity hall. New York; é ß new york city\x0bHall , the of the of the", lang, "s", 0, 1, "h") for k, lang in enumerate(["en", None, "und", "xx", "en"])]
    docs = wordy.unionByName(spark.createDataFrame(extra, wordy.schema))
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, top).collect())
    assert got == collocations_by_hand(docs, least, top) and len(got) > 30


def test_collocations_of_nothing(no_docs):
    assert collocations.collocations(no_docs).count() == 0


def test_crowded_sketch_loses_nothing(spark, wordy, monkeypatch):
    """All phrases in 16 cells: the sketch rejects nothing, the counts are exact."""
    monkeypatch.setattr(collocations, "MOST", 4)
    got = sorted(tuple(r) for r in collocations.collocations(wordy, 3, 100).collect())
    assert got == collocations_by_hand(wordy, 3, 100)


def test_stopped_counters_are_frequent(spark):
    n = collocations.LIMIT + 100
    docs = spark.createDataFrame([(k, "so it goes " * n, "en") for k in range(2)], "doc_id long, text string, lang string").coalesce(1)
    got = {(r.phrase, r.a) for r in collocations.collocations(docs, least=2 * n - 3, top=9).collect()}
    assert got == {(p, a) for _, _, p, a, *_ in collocations_by_hand(docs, 2 * n - 3, 9)} and got
