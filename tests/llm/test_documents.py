"""The document operators against brute force, on odd rows and on none."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F


from loomgraph.llm import bpe, class_lm, jaccard, langid, mixing, sharding, simhash, suffixes
from loomgraph.operators import components


def taken(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


# ---- mixing

@pytest.mark.parametrize("lengths,counts,budget", [([3, 5, 7], [2, 1, 4], 17), ([1000, 7], [50, 3], 20021), ([4], [5], 6), ([2, 9], [3, 3], 0), ([1, 2], [2, 2], 100)])
def test_budget_is_fitted_exactly(lengths, counts, budget):
    import numpy as np

    got = mixing.fit_budget(np.array(lengths), np.array(counts), budget)
    assert (got >= 0).all() and (got <= counts).all()
    sums = {sum(n * size for n, size in zip(c, lengths, strict=True)) for c in itertools.product(*[range(c + 1) for c in counts])}
    assert (got * lengths).sum() == max(s for s in sums if s <= budget)


def test_targets_are_capped_and_reshared():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([20, 590 / 3, 295 / 3])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_mix(odd_docs, no_docs):
    got = mixing.mix_plan(odd_docs)
    rows = taken(got, "doc_id", "size", "source_size", "target", "taken")
    texts = Counter((r.doc_id, len((r.text or "").encode().split())) for r in odd_docs.collect())
    assert Counter((r[0], r[1]) for r in rows) == texts and sorted(map(str, rows)) == sorted(map(str, taken(mixing.mix_plan(odd_docs.repartition(2)), "doc_id", "size", "source_size", "target", "taken")))
    assert all(r[4] in (0, r[1], 2 * r[1]) for r in rows)
    by = {}
    for r in odd_docs.join(got.select(F.col("doc_id").alias("d"), "target", "taken").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).select("source", "target").distinct().collect():
        by[r.source] = r.target
    assert len(by) == odd_docs.select("source").distinct().count()
    for target in set(by.values()):
        own = [r for r in rows if r[3] == target]
        wide = max(r[1] for r in own) if len(own) == 1 else 2
        assert abs(sum(r[4] for r in own) / sum(1 for t in by.values() if t == target) - target) <= wide / 2
    assert mixing.mix_plan(no_docs).count() == 0


# ---- byte-level BPE

def test_bpe(odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = bpe.tokenizer(path, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for text in ("", " ", "a" * 3000, "ab" * 700, "Don't  stop\n\n é漢字🙂 12ab", "<|endoftext|>", "x ​\x1cy"):
        assert coder.encode(text) == ref.encode_ordinary(text) and coder.decode(coder.encode(text)) == text.encode()
    got = {r[0]: r[1:] for r in taken(bpe.token_digests(odd_docs, path, public_tokenizers.PATTERN))}
    for r in odd_docs.collect():
        ids = ref.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.token_digests(no_docs, path, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode_texts(odd_docs, path, public_tokenizers.PATTERN, ["doc_id", "rank"]).columns == ["doc_id", "rank", "ids"]


# ---- sharding

def test_shards(odd_docs, no_docs):
    got = sharding.shard_by_bytes(odd_docs, 4).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    total, largest = sum(sizes.values()), max(r["size"] for r in got)
    assert all(abs(v - total / 4) <= largest for v in sizes.values())
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(no_docs, 4).count() == 0


@pytest.mark.parametrize("shards,copies", [(8, 1), (5, 4), (3, 60)])
def test_cuts_are_the_nearest_ones(spark, shards, copies):
    """The stream that (shard, slot) implies, cut again in plain Python: each cut
    is the row edge next to its target, or the near edge of a run of equal texts."""
    rng = random.Random(shards)
    rows = [(k, f"t{k // copies} " * rng.randrange(1, 40) if copies == 1 else f"text {k // copies} " * (1 + k // copies % 17)) for k in range(400)]
    got = sorted(sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect(), key=lambda r: (r.shard, r.slot))
    ends, runs, at = [0], {}, 0
    for r in got:
        begin, _ = runs.get(r.text_crc32, (at, at))
        at += r["size"]
        runs[r.text_crc32] = (begin, at)
        ends.append(at)
    for k in range(1, shards):
        target, cut = -(-at * k // shards), sum(r["size"] for r in got if r.shard < k)
        run = next(x for x in runs.values() if x[0] < target <= x[1])
        edge = min(run, key=lambda x: (abs(x - target), x))
        want = edge if abs(edge - target) <= 0.02 * at / shards else min(ends, key=lambda x: (abs(x - target), x))
        assert abs(cut - target) == abs(want - target)


def test_copies_stay_together(spark):
    df = spark.createDataFrame([(k, f"text {k // 3} " * 5) for k in range(900)], "doc_id long, text string")
    got = sharding.shard_by_bytes(df, 8).join(df, "doc_id")
    assert got.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    one = spark.createDataFrame([(k, "same") for k in range(800)], "doc_id long, text string")
    assert {r["count"] for r in sharding.shard_by_bytes(one, 8).groupBy("shard").count().collect()} == {100}


# ---- language model

def test_class_model(odd_docs, no_docs):
    train = ~langid.held_out(folds=7)
    got = taken(class_lm.class_scores(odd_docs, train), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    counts, rows = Counter(), []
    for r in odd_docs.collect():
        ws = (r.text or "").encode().lower().split() + [b"\n"]
        aside = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2
        rows.append((r.doc_id, aside, ws))
        if not aside:
            counts.update(ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, aside, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, aside, ws in rows)
    assert Counter((*r[:5], round(r[5], 6)) for r in got) == want
    assert all(r[6] < 0 for r in got)
    assert class_lm.class_scores(no_docs, train).count() == 0


def scores_by_brute_force(texts, train, class_of, many):
    """log10 probabilities under class bigrams, from the classes alone."""
    tokens, words, moves, count = Counter(), Counter(), Counter(), Counter()
    for text, learn in zip(texts, train, strict=True):
        if learn:
            ws = text.lower().split() + [None]
            count.update(ws)
            path = [many, *(class_of[w] for w in ws)]
            moves.update(itertools.pairwise(path))
    for w, n in count.items():
        tokens[class_of[w]] += n
        words[class_of[w]] += 1
    total, into, out = sum(moves.values()), Counter(), Counter()
    for (x, y), n in moves.items():
        out[x] += n
        into[y] += n
    found = []
    for text in texts:
        path, score = many, 0.0
        for w in text.lower().split() + [None]:
            c = class_of[w]
            share = (into[c] + 1) / (total + many + 1)
            score += math.log10((moves[path, c] + class_lm.KAPPA * share) / (out[path] + class_lm.KAPPA))
            score += math.log10((count[w] + class_lm.DELTA) / (tokens[c] + class_lm.DELTA * (words[c] + 1)))
            path = c
        found.append(score)
    return found


def test_class_scores_by_brute_force(spark, monkeypatch):
    """All frequent words: the classes are those of the exchange, made here
    from counts of plain Python; scores follow from them."""
    import numpy as np

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["Red", "blue", "tall"]) + " " + rng.choice(["cat", "dog", "tree"]) for _ in range(rng.randrange(0, 6))) for _ in range(70)]
    train = [k % 3 > 0 for k in range(70)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(class_lm, "CLASSES", 3)
    got = {r.doc_id: r.score for r in class_lm.class_scores(df, F.col("doc_id") % 3 > 0).collect()}
    vocab = sorted({w for t in texts for w in t.lower().split()})
    hashes = {w: next(class_lm.hashed(__import__("pyarrow").array([w])))[2][0] for w in vocab}
    seen = Counter(w for t, x in zip(texts, train, strict=True) if x for w in t.lower().split())
    head = sorted(seen, key=lambda w: (-seen[w], hashes[w]))
    types = {None: 0} | {w: 1 + k for k, w in enumerate(head)}
    many = class_lm.class_count(len(head) + 1)
    classes = np.arange(1 + len(head)) % many
    classes[0] = many

    def around(classes):
        left, right = (np.zeros((len(classes), many + 1), int) for _ in range(2))
        for t, x in zip(texts, train, strict=True):
            if x:
                path = [0, *(types[w] for w in t.lower().split()), 0]
                for a, b in itertools.pairwise(path):
                    left[b, classes[a]] += 1
                    right[a, classes[b]] += 1
        return left, right

    for _ in range(class_lm.PASSES):
        classes = class_lm.exchange(*around(classes), classes)
    want = scores_by_brute_force(texts, train, {w: int(classes[k]) for w, k in types.items()}, many)
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in range(70))


def test_class_model_beats_the_base(spark):
    """Held-out texts of regular sentences are likelier than under the base."""
    rng = random.Random(11)
    kinds = [[f"{p}{k}" for k in range(30)] for p in ("the", "cat", "ran", "far")]
    rows = [(k, " ".join(rng.choice(ws) for _ in range(5) for ws in kinds)) for k in range(600)]
    got = class_lm.class_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 > 0).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** (-got.s / got.n) < 0.4 * 10 ** (-got.b / got.n)


def test_rare_words_go_by_their_contexts(spark, monkeypatch):
    """Words of one ending that stand in different places get classes of their
    own contexts, broadcast or joined."""
    rng = random.Random(5)
    fill = ["red", "blue", "green"], ["runs", "sits", "eats"]
    say = lambda noun, verb: f"{rng.choice(fill[0])} {noun} {rng.choice(fill[1])} {verb}"
    rows = [(k, say(f"n{k % 40}xyz", f"v{k % 40}xyz")) for k in range(400)] + [(400 + k, say("apple", "often")) for k in range(400)]
    probe = [(1000, "red n7xyz runs v7xyz"), (1001, "red v7xyz runs n7xyz")]
    df = spark.createDataFrame(rows + probe, "doc_id long, text string")
    monkeypatch.setattr(class_lm, "HEAD_SHIFT", 6)
    found = []
    for shift in (18, 6):
        monkeypatch.setattr(class_lm, "COMMON_SHIFT", shift)
        got = {r.doc_id: r.score for r in class_lm.class_scores(df, F.col("doc_id") < 1000).collect()}
        assert got[1000] > got[1001] + 1
        found.append(got)
    assert all(math.isclose(found[0][k], found[1][k], abs_tol=1e-6) for k in found[0])
    assert class_lm.class_count(10) == 32 < class_lm.class_count(10**6) < class_lm.class_count(10**8)


# ---- language identification

def test_language(spark, odd_docs, no_docs):
    en = "the house and the garden with other things that were there when they came over "
    de = "das haus und der garten mit anderen dingen die dort waren als sie zurück kamen "
    rows = [(k, (en if k % 2 else de)[k % 20 :] * 3, "en" if k % 2 else "de") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_of(df).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    odd = {r.doc_id: r for r in langid.language_of(odd_docs).collect()}
    assert {odd[k].lang_pred for k in (90, 91, 92, 94)} == {"und"} and odd[90].score == 0 and odd[96].lang_pred in ("en", "de")
    assert langid.language_of(no_docs).count() == 0
    assert {r.lang_pred for r in langid.language_of(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_junk_and_unlearned_languages_are_rejected(spark):
    rng = random.Random(4)
    learned = {"en": "the house and garden with other things that were there when they came over this river for their holidays".split(), "de": "das haus und der garten mit anderen dingen die dort waren als sie über den fluss zurück kamen".split()}
    say = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    rows = [(k, say(learned[lang], rng.randrange(3, 300)), lang) for k in range(800) for lang in [("en", "de")[k % 2]]]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    letters = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "กขคงจฉชซญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหอฮ", "".join(map(chr, range(0x4E00, 0x5200)))]
    words = [["".join(rng.choices(a, k=rng.randrange(2, 9))) for _ in range(2000)] for a in letters] + ["minä olen hyvin iloinen koska aurinko paistaa tänään ja linnut laulavat pihalla".split()]
    probe = [(f"junk{k}", say(ws, n)) for k, ws in enumerate(words) for n in (10, 100, 1000) for _ in range(10)]
    probe += [(lang, say(ws, n)) for lang, ws in learned.items() for n in (3, 10, 100, 1000) for _ in range(10)]
    got = langid.identify(spark.createDataFrame(probe, "kind string, text string"), model).collect()
    assert [(r.kind, len(r.text)) for r in got if r.rejected != r.kind.startswith("junk")] == []
    assert all(r.kind == r.lang_pred for r in got if not r.rejected)


# ---- suffix array

def removed_by_brute_force(docs, length):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(taken(suffixes.repeat_digests(odd_docs, 200))) == removed_by_brute_force(docs, 200)
    assert suffixes.repeat_digests(no_docs, 200).count() == 0
    cleaned = suffixes.without_repeats(odd_docs, 200)
    assert cleaned.columns == odd_docs.columns and cleaned.where("doc_id = 90 and text is null").count() == 1


def test_frequent_passages_change_nothing(spark, monkeypatch):
    """A passage in most documents, with and without its strings held frequent."""
    import random

    rng = random.Random(9)
    line = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    passage = line(100)
    docs = [(k, f"{line(15)} {passage[k % 7:]} {line(12)}") for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = removed_by_brute_force(docs, 200)
    monkeypatch.setattr(suffixes, "SAMPLE", 1)
    rows = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    assert len(suffixes._frequent(rows, 8, 200)[0]) > 0 and suffixes._frequent(rows, 8, 200)[1] == 8
    monkeypatch.setattr(suffixes, "BUCKET", 9000)
    assert suffixes._frequent(rows, 8, 200)[1] > 8
    assert Counter(taken(suffixes.repeat_digests(df, 200))) == want


def test_merge_keeps_prefix_lengths():
    import random

    rng = random.Random(4)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))) for _ in range(5)]

    def coded(run):
        last = b""
        for s in run:
            yield s, suffixes.common(last, s, 0), None
            last = s

    got = list(suffixes.merge_runs([coded(r) for r in runs]))
    assert [g[0] for g in got] == sorted(itertools.chain(*runs))
    assert all(n == suffixes.common(a, b, 0) for (a, _, _), (b, n, _) in itertools.pairwise(got))


# ---- SimHash

def test_fingerprints(odd_docs, no_docs):
    unique = odd_docs.dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in unique.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = {r.doc_id: r for r in simhash.edited_fingerprints(unique).collect()}
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    assert got[80].fingerprint == got[81].fingerprint == got[84].fingerprint and got[70].fingerprint != got[96].fingerprint
    assert 0 <= min(r.near_next for r in got.values()) and max(r.near_edited for r in got.values()) <= 1
    assert simhash.edited_fingerprints(no_docs).count() == 0


@pytest.mark.parametrize("block,radius", [(1024, 3), (5, 3), (1024, 6)])
def test_all_fingerprints_within_radius(spark, monkeypatch, block, radius):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    prints = [rng.getrandbits(128) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(1, 6))) for p in prints for _ in range(3)]
    prints += [prints[0] ^ (1 << k) ^ (1 << 127 - k) for k in range(60)] + prints[:5]  # a crowd, and repeats
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,)], "fingerprint string")
    want = Counter()
    for a, b in itertools.combinations(set(prints), 2):
        if (a ^ b).bit_count() <= radius:
            want.update([f"{a:032x}", f"{b:032x}"])
    assert {r.fingerprint: r.n_near for r in simhash.within_radius(df, radius).collect()} == want
    if radius == 6:
        got = simhash.with_near(df.withColumn("k", F.lit(1)), radius)
        assert got.count() == len(prints) + 1 and {r.fingerprint: r.n_near for r in got.collect() if r.n_near} == want


def test_fingerprint_values_by_plain_votes(spark):
    """Every bit of a fingerprint is the sign of the weighted votes of terms."""
    import numpy as np
    import pyarrow as pa

    from loomgraph.llm.text import U, mix, shingles, word_hashes

    texts = ["One two three two THREE one two", "lone", "", "a b a b a b c"]
    got = simhash.fingerprints(pa.array(texts))
    for text, print_ in zip(texts, got, strict=True):
        ws = text.lower().split()
        terms = Counter(" ".join(ws[k : k + 2]) for k in range(max(1, len(ws) - 1))) if ws else {}
        votes = [0] * 128
        for term, n in terms.items():
            raw = np.frombuffer(term.encode(), np.uint8)
            h = shingles(*word_hashes(raw, np.array([0, len(raw)])), 2)[0]
            bits = np.unpackbits(np.stack([h, mix(h + U(1))], axis=1).view(np.uint8))
            for k in range(128):
                votes[k] += n if bits[k] else -n
        assert np.unpackbits(print_).tolist() == [int(v > 0) for v in votes]
    assert simhash.likeness(got[:1], got[:1])[0] == 1 and math.isclose(simhash.likeness(got[:1], got[1:2])[0], max(0, math.cos(math.pi * np.unpackbits(got[0] ^ got[1]).sum() / 128)))


# ---- Jaccard join

def classes_by_brute_force(docs, threshold=0.8):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(docs), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, low.get(find(i), d), links[i]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard(odd_docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = Counter(taken(jaccard.jaccard_join(odd_docs), "doc_id", "class_id", "n_links"))
    assert got == classes_by_brute_force(docs)
    if block == 512:
        assert jaccard.jaccard_join(no_docs).count() == 0


def test_depth_reaches_the_recall():
    d = jaccard.depth_for(0.8)
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


@pytest.mark.parametrize("small", [48, 3])
def test_prefixes_are_shortened_as_far_as_needed(monkeypatch, small):
    """Near copies meet under long prefixes, looser neighbours under shorter
    ones, and the cells are those of all pairs of a subtree."""
    import numpy as np

    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard.small_pairs, "__defaults__", (small,))
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, (6, 600), np.uint64)
    sets = []
    for k in range(240):
        s = base[k % 6].copy()
        some = rng.choice(600, [0, 6, 40, 70][k % 4], replace=False)
        s[some] = rng.integers(0, 1 << 32, len(some), np.uint64)
        sets.append(np.unique(s))
    sig = np.stack([jaccard.signature(x) for x in sets])
    least, floor, lengths = 0.63 * sig.shape[1], jaccard.depth_for(0.8), set()
    for tree in range(4):
        labels = sig[:, tree * jaccard.DEPTH : (tree + 1) * jaccard.DEPTH]
        order = np.lexsort(labels.T[::-1])
        labels, mine = labels[order], sig[order]
        top = [tuple(x[:floor]) for x in labels]
        bounds = np.array([0] + [k for k in range(1, 240) if top[k] != top[k - 1]] + [240])
        x, y, length = jaccard.forest_links(labels, mine, bounds, least, floor)
        lengths |= set(length.tolist())
        p, q = np.triu_indices(240, 1)
        ok = np.array([top[i] == top[j] for i, j in zip(p, q, strict=True)]) & ((mine[p] == mine[q]).sum(axis=1) >= least)
        assert (components.spanning(240, x, y) == components.spanning(240, p[ok], q[ok])).all()
        assert all((labels[i, :d] == labels[j, :d]).all() for i, j, d in zip(x, y, length, strict=True))
    assert len(lengths) > 2 and max(lengths) == jaccard.DEPTH and min(lengths) >= floor


def test_exact_links_count_whole_sets():
    import numpy as np

    many = [np.arange(k, 5000 + k, dtype=np.uint64) for k in (0, 500, 1500, 4999, 0, 556, 20, 9000)]
    want = [(i, j) for i, j in itertools.combinations(range(8), 2) if len(set(many[i]) & set(many[j])) >= 0.8 * len(set(many[i]) | set(many[j]))]
    assert list(zip(*map(list, jaccard.exact_links(many, 0.8)), strict=True)) == want


def test_marks_of_the_knapsack_change_nothing(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 200, 12))
        counts = rng.integers(1, 9, len(lengths))
        budget = int(rng.integers(1, 1 + int((lengths * counts).sum())))
        found = []
        for mark in (64, 3, 1):
            monkeypatch.setattr(mixing, "MARK", mark)
            found.append(mixing.fit_budget(lengths, counts, budget).tolist())
        assert found[0] == found[1] == found[2]
